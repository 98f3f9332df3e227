"""Personal information in free text: a semi-Markov conditional random field over token spans.

Every span of up to a bounded number of words that could be personal by its shape alone (capitals for names, six digits
for numbers, a number beside words for streets, an at-sign for addresses of mail) is a candidate, digits as phone and as
identity number. Features of the whole span (letter groups, shapes, words) and of the words around it score it, and a
dynamic program over the candidates of a text picks the non-overlapping ones of the greatest sum, so that bounds and types
are chosen together; what no chosen span covers is ordinary text. The weights are learnt by maximum likelihood
(forward-backward over the same candidates) from labelled sentences that are composed here from common phrases, names and
number formats; no list of names is asked when texts are searched. Scripts without capitals are covered for Korean only.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("name", "email", "phone", "id_number", "street_address")

# Given names that training sentences are composed with.
GIVEN = sorted(set(
    "Adam Adrian Alan Alba Albert Alex Alexander Alice Alina Amelie Ana Andrea Andreas Anna Anne Anton Antonio Arthur Beatriz Ben Bernd "
    "Birgit Brigitte Bruno Camille Carla Carlos Carmen Carol Caroline Charles Charlotte Chloe Christian Claire Clara Claudia Clement Daniel "
    "David Diana Diego Dieter Dmitri Dorothea Edgar Elena Eli Elisa Elsa Emil Emilia Emily Emma Erik Ernst Eva Felix Fernando Fiona Florian "
    "Frank Franz Frida Gabriel Georg Greta Guido Gustav Hanna Hannah Hans Helena Helga Henri Henry Hugo Ida Ines Ingrid Irene Isabel Ivan "
    "Jack Jakob James Jan Jana Javier Jean Jens Joan Johan John Jonas Jorge Jose Juan Julia Jules Julien Karin Karl Katja Klaus Lara Laura "
    "Lea Lena Leo Leon Linda Lisa Louis Lucas Lucia Luis Lukas Luna Manuel Marco Maria Marie Marion Mark Marta Martin Mary Mathis Max Mia "
    "Michael Miguel Mila Mira Nadia Nathan Nicole Nina Noah Noemi Nora Olga Oliver Oskar Otto Pablo Pascal Paul Paula Pedro Peter Petra "
    "Philipp Pierre Rafael Richard Robert Rosa Ruth Sabine Samuel Sandra Sara Sarah Sebastian Simon Sofia Sonja Sophie Stefan Susan Theo "
    "Thomas Tim Tobias Tom Ursula Uwe Vera Victor Viktor Walter Werner Yvonne "
    "Ahmed Aisha Akira Amara Anjali Arjun Ayşe Björn Chen Chinua Deepak Dimitri Eoin Fatima Grzegorz Haruki Hiroshi Ibrahim Ingeborg Jiří Kavita "
    "Kenji Lakshmi Mehmet Mei Minh Mohammed Nguyen Nikolai Niamh Olumide Paweł Rashid Ravi Sakura Siobhán Søren Takeshi Tariq Thandiwe Wei Zanele Zoltán "
    "Александр Анна Дмитрий Елена Иван Мария Ольга Сергей Γιώργος Ελένη".split()
))
# Endings of family names used to compose training sentences, and words that name kinds of streets.
ENDINGS = "son sen mann ström stroem quist berg lund holm mark hagen wick ova kova enko anoff ov etti elli ini iera ero era eau ard al ling el er ez".split()
STREETS_BEHIND = "Street Road Lane Avenue Ave. Ave Blvd Boulevard Court Drive Way Square Place St. St Rd. Rd Terrace Close Crescent Row".split()
STREETS_BEFORE = "rue avenue chemin boulevard place impasse quai allée route Calle Avenida Paseo Plaza Camino Carrera Ronda Rua Via".split()
KOREAN_FAMILY = "김이박최정강조윤장임한오서신권황안송류홍전고문양손배백허유남심노하곽성차주우구민진나지엄채원천방공현함변염여추도소석선설마길연위표명기반왕금옥육인맹제모탁국"
KOREAN_GIVEN = "강건경광교구규근기길나남다단담대도동란람래려련령로루류름리린림마만명모무문미민바배백범별병보복봄빈상새서석선설섭성세소솔송수숙순슬승시신아안애양연열영예오옥온완요용우욱운웅원월유윤율은의이익인일임자장재정제조종주준중지진찬창채천철청초춘충치태택평표하학한해향헌혁현형혜호홍화환회효후훈휘희"
STREETS_JOINED = "straße strasse weg platz gasse allee ring ufer damm str.".split()

def _ranges(kind: str, last: int = 0x24FF) -> str:
    """The letters of a general category as ranges of a character class."""
    found, start = [], None
    for i in range(last + 2):
        if i <= last and unicodedata.category(chr(i)) == kind:
            start = i if start is None else start
        elif start is not None:
            found.append(f"{chr(start)}-{chr(i - 1)}" if i - 1 > start else chr(start))
            start = None
    return "".join(found)


_UPPER = _ranges("Lu")
#: Signs that stand in a word where letters were decoded wrongly.
_ODD = r"[^\x00-\x7f\s‐-―‘-‟…«»　-〿가-힣\w]"
_ODD = rf"(?:{_ODD}|(?<=[a-z])[“”‘„‚](?=[a-z]))"
_INNER = rf"(?:[^\W\d_]|{_ODD})"
_CAPITAL = rf"(?:[{_UPPER}]|{_ODD}(?=[^\W\d_]))"
#: A capitalised word, with apostrophes and hyphens within.
_WORD = rf"{_CAPITAL}(?:{_INNER}|['’](?=[{_UPPER}])|-(?={_CAPITAL}))+"
_SMALL = r"[a-zà-ÿ]{1,3}"
#: Words of a name: capitalised, an initial, or small particles in between.
_RUN = re.compile(rf"(?<![\w@/.'’-]){_WORD}(?: (?:{_WORD}|[{_UPPER}]\.|(?:{_SMALL} ){{1,2}}(?={_CAPITAL}){_WORD}))+(?![\w@(+])")
_PART = re.compile(r"[^ ]+")
_ONE_WORD = re.compile(_WORD)
_HANGUL = re.compile(r"(?<!\w)[가-힣]{2,4}(?!\w)")
_MAIL = re.compile(
    r"(?<![\w.+-])[\w][\w.+-]*(?:@| ?[\[({] ?(?:at|AT) ?[\])}] ?| at (?=[\w-]+ dot ))[\w-]+"
    r"(?:(?:\.| ?[\[({] ?(?:dot|DOT) ?[\])}] ?| dot )[\w-]+)*(?:\.| ?[\[({] ?(?:dot|DOT) ?[\])}] ?| dot )[A-Za-z][\w-]+"
)
_MAIL_CUE = re.compile(r"@|[\[({] ?(?:at|AT) ?[\])}]| at [\w-]+ dot ")
_GROUP = r"[A-Z]{0,4}\d[A-Z0-9]*"
_NUMBERS = re.compile(rf"(?<![A-Za-z0-9_])[+(]{{0,2}}{_GROUP}(?:[ ./()-]{{1,3}}{_GROUP})*(?![\w])")
_GROUPS = re.compile(r"[A-Z0-9]+")
#: A house number with a word behind it, and one with a word before it.
_HOUSE_BEFORE = re.compile(r"(?<![\w.,/#+:-])\d{1,4}[A-Za-z]?(?: ?(?:bis|ter))?,? (?=[^\W\d_])")
_HOUSE_BEHIND = re.compile(r"(?<=[^\W\d_])(\.?,? (?:n\.?º ?|[Nn]o\.? ?|[Nn]r\.? ?)?)\d{1,4}[A-Za-z]?(?![\w/-]|\.\w)")
_STREET_WORD = re.compile(rf"({_WORD})(\.?)(?!\w)[ -]?|[a-zà-ÿ]{{1,10}} |[dl]['’]")
#: Most words of a name and of a street, most groups of a number.
NAME_WORDS, STREET_WORDS, NUMBER_GROUPS = 6, 5, 9

Segment = tuple[int, int, str]


def _names(text: str) -> Iterator[Segment]:
    for run in _RUN.finditer(text):
        parts = [(run.start() + m.start(), run.start() + m.end()) for m in _PART.finditer(run[0])]
        whole = [text[a] in _UPPER_SET and text[b - 1] != "." or ord(text[a]) > 127 for a, b in parts]
        for i, (a, _) in enumerate(parts):
            if whole[i]:
                for j in range(i + 1, min(len(parts), i + NAME_WORDS)):
                    if whole[j]:
                        yield a, parts[j][1], "name"
    if not text.isascii():
        for m in _HANGUL.finditer(text):
            yield m.start(), m.end(), "name"


def _number_spans(text: str) -> Iterator[Segment]:
    for run in _NUMBERS.finditer(text):
        if len(run[0]) < 6:
            continue
        groups = [(run.start() + m.start(), run.start() + m.end()) for m in _GROUPS.finditer(run[0])]
        digits = [sum(c.isdigit() for c in text[a:b]) for a, b in groups]
        if sum(digits) < 6:
            continue
        for i, (a, _) in enumerate(groups):
            if i and not text[groups[i - 1][1] : a].endswith((" ", "(", "+")):
                continue  # a span doesn't begin within what belongs together
            before = text[max(run.start(), groups[i - 1][1] if i else 0) : a]
            start = a - len(before) + len(before.rstrip("+(")) if before else a
            held = 0
            for j in range(i, min(len(groups), i + NUMBER_GROUPS)):
                held += digits[j]
                b = groups[j][1]
                if held < 6 or held > 24 or b - a > 40 or (j + 1 < len(groups) and text[b] != " " and not text.startswith(") ", b)):
                    continue
                for left in {a, start}:
                    if text[left:b].count("(") == text[left:b].count(")"):
                        yield left, b, "phone"
                        if left == a:
                            yield a, b, "id_number"


def _streets(text: str) -> Iterator[Segment]:
    for m in _HOUSE_BEFORE.finditer(text):
        at, stop = m.end(), m.end() + 80
        capitals, small = 0, 0
        while capitals < STREET_WORDS and (w := _STREET_WORD.match(text, at, stop)):
            if w[1]:
                capitals += 1
                yield m.start(), w.end(2), "street_address"
                if w[2]:  # what goes on after it is another sentence
                    yield m.start(), w.end(1), "street_address"
                    break
            elif len(w[0]) > 4 and (capitals or small):
                break
            small += 1
            at = w.end()
    for m in _HOUSE_BEHIND.finditer(text):
        begin = max(text.rfind("\n", 0, m.start()) + 1, m.start() - 80)
        parts = list(re.finditer(r"[^\s-]+", text[begin : m.start()]))[-2 * STREET_WORDS :]
        capitals = 0
        for part in reversed(parts):
            if _ONE_WORD.fullmatch(part[0]):
                capitals += 1
                yield begin + part.start(), m.end(), "street_address"
            elif not capitals or not part[0].islower() or len(part[0]) > 3:
                break
            if capitals == STREET_WORDS:
                break


_UPPER_SET = frozenset(c for c in map(chr, range(0x250)) if unicodedata.category(c) == "Lu") | frozenset(
    c for c in map(chr, range(0x250, 0x2500)) if unicodedata.category(c) == "Lu"
)


def candidates(text: str) -> list[Segment]:
    """The spans of a text that might be personal, sorted by end. None crosses a line; in a passage written in capitals
    only, and in words with more signs than letters, capitals tell nothing, so nothing there is a name or a street."""
    worded = (s for s in (*_names(text), *_streets(text)) if not text[max(0, s[0] - 12) : s[1] + 12].isupper() and 2 * len(_SIGN.findall(text, s[0], s[1])) < s[1] - s[0] and not (s[2] != "name" and _SIGN.search(text, s[0], s[1]) and s[1] - s[0] < 11))
    found = {*worded, *_number_spans(text)}
    for cue in _MAIL_CUE.finditer(text):
        at = max(text.rfind("\n", 0, cue.start()) + 1, cue.start() - 80)
        found.update((m.start(), m.end(), "email") for m in _MAIL.finditer(text, at, min(len(text), cue.end() + 120)) if m.end() > cue.start() >= m.start())
    return sorted((s for s in found if "\n" not in text[s[0] : s[1]]), key=lambda s: (s[1], s[0], s[2]))


_KINDS = frozenset(STREETS_BEHIND)
_MIXED = re.compile(r"[a-zA-Z][\u0370-\u05ff]|[\u0370-\u05ff][a-zA-Z]")
_SIGN = re.compile(r"[^\w\s.'’,-]|[\u00c0-\u00c5\u00e2\u00e3\u00ea-\u00ed](?=[^\w\s])")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
_SHAPE = re.compile(r"\d")


def _shape(text: str) -> str:
    return re.sub(rf"[{_UPPER}]", "A", re.sub(r"[^\W\d_A]+", "a", re.sub(rf"[{_UPPER}]", "A", _SHAPE.sub("9", text))))[:30]


def _letters(word: str, name: str) -> list[str]:
    """Groups of two to four letters at the ends of a word, and of three within."""
    low = f"^{word.lower()}$"
    return [f"{name}:{low[:3]}", f"{name}:{low[:4]}", f"{name}:{low[-3:]}", f"{name}:{low[-4:]}", f"{name}:{low[-5:]}", *[f"{name}+{low[i : i + 3]}" for i in range(1, len(low) - 3)]]


def features(text: str, segment: Segment) -> list[str]:
    """Names of the whole-span features of a segment, each with its type."""
    a, b, kind = segment
    span = text[a:b]
    begin, end = text.rfind("\n", max(0, a - 40), a) + 1 or max(0, a - 40), text.find("\n", b, b + 24)
    before, after = _TOKEN.findall(text[begin:a]), _TOKEN.findall(text[b : b + 24 if end < 0 else end])
    words = [w.lower() for w in before if w[0].isalpha()]
    last = words[-1] if words else "^"
    near = "".join(before[-1:]).lower()
    out = [
        "bias",
        f"left:{near}",
        f"touch:{text[a - 1 : a] if text[a - 1 : a].strip() else ' '}{text[b : b + 1] if text[b : b + 1].strip() else ' '}",
        f"word-1:{last}",
        f"word-1 ends:{last[-3:]}",
        f"word-2:{' '.join(words[-2:])}",
        f"left+word:{near if not near.isalpha() else ''}:{last}",
        f"right:{''.join(after[:1]).lower() or '$'}",
        f"next:{next((w.lower() for w in after if w[0].isalpha()), '$')}",
        f"line:{not words}:{not after}",
    ]
    if before[-1:] in (["x"], ["0"]):
        out.append("hex")
    if kind == "name" and "가" <= span[0] <= "힣":
        out = [f"korean:{f}" for f in out]
        around = [(text[begin:a].rstrip() or " ")[-1], (text[b : b + 2].strip() or " ")[0]]
        out += [f"korean around:{'가' <= around[0] <= '힣'}:{'가' <= around[1] <= '힣'}", f"syllables:{len(span)}"]
        out += [f"surname:{span[0] in KOREAN_FAMILY}:{len(span)}", f"family:{span[0]}", f"second:{span[1]}", f"ends:{span[-1]}", f"ends2:{span[-2:]}"]
    elif kind == "name":
        parts = span.split(" ")
        whole = [w for w in parts if w[0] in _UPPER_SET or ord(w[0]) > 127]
        small = [w for w in parts if w not in whole]
        out += [
            f"shape:{' '.join('A.' if w.endswith('.') else 'Aa' if w in whole else 'a' for w in parts)}",
            f"capitals:{any(len(w) > 1 and w[1:2].isupper() for w in whole)}",
            f"signs:{min(4, len(_SIGN.findall(span)))}",
            f"inner capitals:{min(3, sum(c.isupper() for w in whole for part in re.split('[-’' + chr(39) + ']', w) for c in part[1:]))}",
            f"foreign:{min(4, sum(ord(c) > 127 for c in span))}:{_MIXED.search(span) is not None}",
            f"street kind:{any(w in _KINDS for w in parts)}",
            f"script:{'latin' if parts[0][0] < 'ɐ' else 'other'}",
            f"lengths:{min(9, len(parts[0]))}:{min(9, len(parts[-1]))}",
            f"joined:{'-' in parts[-1]}:{chr(39) in span or '’' in span}",
            *[f"small:{w}" for w in small],
            *_letters(parts[0], "given"),
            *_letters(re.split("[-'’]", parts[-1])[-1], "family"),
        ]
        out += [f"middle:{w.lower()[-3:]}" for w in parts[1:-1] if w in whole and not w.endswith(".")]
        out += _goes_on(text, a, b)
    elif kind == "email":
        spelled = "plain" if "@" in span else "bracket" if re.search(r"[\[({]", span) else "words"
        out += [f"spelled:{spelled}", f"local:{re.split(r'[@ ]', span)[0].lower()}", f"top:{re.split(r'[^A-Za-z]', span)[-1].lower()}"]
        out += [f"digits only:{re.search(r'[A-Za-z]', span.split('@')[-1]) is None}", f"follow:{text[b : b + 1]}"]
    elif kind in ("phone", "id_number"):
        digits = sum(c.isdigit() for c in span)
        groups = re.sub(r"\d+", lambda m: str(min(9, len(m[0]))), span)
        out += [
            f"groups:{groups}",
            f"shape:{_shape(span)}",
            f"digits:{digits}",
            f"begins:{span[0] if span[0] in '+(0' else '9' if span[0].isdigit() else 'A'}",
            f"begins2:{span[:2]}",
            f"ends in letter:{span[-1].isalpha()}",
            f"marks:{''.join(sorted(set(re.sub(r'[A-Z0-9]', '', span))))}",
            f"letters:{''.join(c for c in span if c.isalpha())[:2]}" if not span.isdigit() else f"plain:{digits}",
            f"goes on:{bool(re.match(r'[ ./-]{1,2}[(]?[0-9]', text[b : b + 4]))}:{bool(re.search(r'[0-9][)]?[ ./-]{1,2}$', text[max(0, a - 4) : a]))}",
        ]
    else:
        named = _WORDS.findall(span)
        behind = span[0].isdigit()
        out = [f"{'behind' if behind else 'before'} {f}" for f in out] + out[1:4]
        out += [
            f"shape:{_shape(re.sub(_WORD, 'A', span))}",
            f"words:{len(named)}:{behind}",
            f"signs:{min(3, len(_SIGN.findall(span)))}",
            f"shortest:{min(4, min(map(len, named)))}",
            *[f"word:{w.lower()}" for w in named],
            f"last:{named[-1].lower()}:{behind}",
            f"first:{named[0].lower()}:{behind}",
            *[f"ends{n}:{named[-1 if behind else 0].lower()[-n:]}:{behind}" for n in (3, 4, 5)],
            f"dot:{span.endswith('.')}:{named[-1].lower() if behind else ''}:{text[b : b + 1]}",
            *_goes_on(text, a, b),
        ]
    return [f"{kind}|{f}" for f in out]


_WORDS = re.compile(r"[^\W\d_]+")


def _goes_on(text: str, a: int, b: int) -> list[str]:
    """Whether capitalised words stand right beside a span, and whether all is written in capitals."""
    back, on = text[max(0, a - 24) : a].split(), text[b : b + 2]
    before = bool(back) and text[a - 1 : a] == " " and back[-1][0].isupper()
    after = on[:1] == " " and on[1:].isupper()
    return [f"capitals beside:{before}:{after}", f"capital behind:{after}", f"all capitals:{text[a:b].isupper()}", f"all capitals:{text[max(0, a - 12) : b + 12].isupper()}:around"]


@dataclass
class SemiMarkovCRF:
    """``weights`` of features; unknown ones weigh nothing."""

    weights: dict[str, float]

    def score(self, line: str, segment: Segment) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(line, segment))

    def decode(self, line: str) -> list[Segment]:
        """The non-overlapping candidates of a text with the greatest sum of scores (ties: fewer segments)."""
        found = candidates(line)
        if not found:
            return []
        ends = [s[1] for s in found]
        best: list[tuple[float, int]] = [(0.0, -1)]  # over the first i candidates: total, and the one chosen last or -1
        for i, s in enumerate(found):
            before = bisect_right(ends, s[0], 0, i)
            total = best[before][0] + self.score(line, s)
            best.append((total, i) if total > best[i][0] + 1e-9 else (best[i][0], -1))
        out, i = [], len(found)
        while i > 0:
            if best[i][1] < 0:
                i -= 1
                continue
            out.append(found[i - 1])
            i = bisect_right(ends, found[i - 1][0], 0, i - 1)
        return out[::-1]

    @classmethod
    def fit(cls, rows: list[tuple[str, set[Segment]]], epochs: int = 6, rate: float = 0.3, decay: float = 1e-4) -> SemiMarkovCRF:
        """Maximum likelihood by AdaGrad: the gradient of a line is gold minus expected segment features. Weights are the means of
        the later epochs."""
        known: dict[str, int] = {}
        read = []
        for line, gold in rows:  # candidates and features are the same in every epoch
            if found := candidates(line):
                named = [[known.setdefault(f, len(known)) for f in features(line, s)] for s in found]
                ends = [s[1] for s in found]
                before = [bisect_right(ends, s[0], 0, i) for i, s in enumerate(found)]
                by_start = sorted(range(len(found)), key=lambda i: -found[i][0])
                read.append((found, named, before, by_start, [s in gold for s in found], len(line)))
        weights, seen, mean = [0.0] * len(known), [1e-6] * len(known), [0.0] * len(known)
        order = random.Random(7)
        for epoch in range(epochs):
            order.shuffle(read)
            for found, named, before, by_start, right, length in read:
                scores = [min(30.0, sum([weights[f] for f in fs])) for fs in named]
                # Forward over ends, backward over starts; log sums of all choices of non-overlapping segments.
                forward = [0.0]
                for i, score in enumerate(scores):
                    forward.append(_log_add(forward[i], forward[before[i]] + score))
                backward: list[tuple[int, float]] = [(length + 1, 0.0)]
                after = {}
                for i in by_start:
                    after[i] = _at_or_after(backward, found[i][1])
                    backward.append((found[i][0], _log_add(backward[-1][1], after[i] + scores[i])))
                total = forward[-1]
                for i, score in enumerate(scores):
                    gradient = right[i] - math.exp(min(0.0, forward[before[i]] + score + after[i] - total))
                    if abs(gradient) > 1e-3:
                        for f in named[i]:
                            g = gradient - decay * weights[f]
                            seen[f] += g * g
                            weights[f] += rate * g / math.sqrt(seen[f])
            if epoch >= epochs // 2:
                mean = [m + w for m, w in zip(mean, weights, strict=True)]
        kept = epochs - epochs // 2
        return cls({f: mean[i] / kept for f, i in known.items() if abs(mean[i]) > 1e-4})


def _log_add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def _at_or_after(backward: list[tuple[int, float]], place: int) -> float:
    """The log sum of choices among segments that start at or after ``place``; starts descend along the list."""
    low, high = 0, len(backward)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if backward[middle][0] >= place else (low, middle)
    return backward[low][1]


# Phrases of the training sentences. {n} name, {e} email, {p} phone, {i} id number, {s} street address,
# {w} a made-up word, {W} one in capitals, {d} a number that is none of these, {k} a small one, {v} a version, {u} a serial
# number, {N} a noun in capitals, {o} a Korean word, {T} a thing named after a person.
PHRASES = """Author: {n}|@author {n}|Author {n}|Authors: {n}, {n}|Signed: {n}|Signed: Dr. {n}|Signed by {n}|Signed-off-by: {n} <{e}>|Reviewed-by: {n}|Tested-by: {n}|Contact is {n}, first floor.|Contact: {n}|thanks to {n} for the help
cc {n}|cc: {n} and {n}|Ask {n} about it.|Please ask {n} first.|The minutes of {n} name two items.|The notes of {n} are kept.|{n} measured it on the bench.|{n} wrote this.|written by {n}|Ansprechpartner: {n}|Bearbeiter: {n}|Verantwortlich: {n}|Prüfer: {n}
Frau {n}|Herr {n} meldet sich.|Responsable : {n}|Responsable du lot : {n}|Auteur : {n}|M. {n}|Mme {n}|Revisado por {n}|Responsable: {n}|Autor: {n}|담당자: {n}|작성자: {n}|담당 {n}|검토자: {n}|contact {n} at {p}|{n} ({e})|by {n}|name={n}|for {n}, please|Maintainer: {n} <{e}>|{n}, {p}|Dear {n},|Регистрация: {n}
Write to {e} now|Contact: <{e}>|Questions? {e}|Reported by {e}|(owner {e})|maintainer={e}|Mail {e} for details.|E-Mail: {e}|Fragen an {e} senden.|écrire à {e}|correo: {e}|문의: {e}|{e}
Call {p} if it fails.|Tel. {p}|tel:{p}|Fax/Tel: {p}|Phone: {p}|phone={p}|mobile {p}|Night desk: {p}|Reach us on {p}.|Durchwahl {p}|Telefon: {p}|Tél. {p}|Teléfono {p}|전화 {p}|{p}|☎ {p}
passport no. {i}|Passport: {i}|Social security number: {i}|SSN {i}|Tax ID {i} on paper|ID card {i} was seen|his national ID {i}|resident registration {i}|Ausweisnummer {i}|Steuernummer {i}|numéro de passeport {i}|documento n.º {i}|DNI {i}|NIE: {i}|주민등록번호 {i}|여권 {i}|IBAN {i}|identity number {i}
Lab: {s}|Office: {s}|Ship it all to {s}.|Send crates to {s}.|It went to {s} by car|mail goes to {s}|bring it to {s}|Deliver to {s}, ground floor.|home address {s}|Address: {s}|lives at {s}|We moved from {s} in spring.|Lieferanschrift: {s}|Anschrift: {s}|Atelier : {s}|Adresse : {s}|Entregar en {s}|Dirección: {s}|배송지: {s}|주소: {s}
The {T} comes after the {w}.|A {T} sits in front of a {T}.|Every {W} {S} {W} has bay {k}.|Bay {k} {W} {S} Diagram: {d} tracks.|{W} {S} {W}, tray {k}.|{W} {S} {W} {k}|The {W} {S} {N}, pin {k}|Line {k} {N} {S} Chart: {d}|Line {k} {W} {S} Chart: {d}|Sheet {k} {W} {S} View: {d} lines.|Path {k} {N} {S} Plan|Row {k} {N} {S} Table: {k} pins.|{k} {N} {S} {N}|{k} {W} {S} {N}: {d}|Checksum {d}-{w}, address 0x{d}.|Apply @{w} to {d}.|package {w}@{v} locked.|{w}@{v}|{w}@{v} is pinned
Clone git@{w}.{w}.example:fw/{w}.git now.|git@{w}.example.com:{w}/{w}.git|ssh {w}@{w}-01|Part no. {d}-B, lot {d}.|Sample count {d} of {k} runs.|Build {v}-rc1, firmware {v}.|MAC {d}:{k}, SN{d}.|serial number {d}|version {v}|Register {d}|Part {d}, revision {k}|lot {d}
{w}: {d}|'{w}', {d}|offset {d} size {d}|{W} {W} for {w}|{W} helper.|The {W} {W} of the {w} must hold|{k} {W} {w}|Board: {W} {W}|Copyright (c) {W} Labs|{d}|{w} {d} {w}|Figure {k} Main Road Test|Table {k}|Page {k}|Register {k}|Step {k}: {W}|see {W} {T}|## {W} {N}|# {W} {N} {w}|{W} {N}|{N} {W} für {W}|{W}- {N} prüft|the {W} {N}|{N} {N}|{W} {o} {o}는 {w} {o}|{o} {w} {o}을 {o}|{W}의 {o} {o}은 {o}한다|## {w} {o}|{d} 이상은 {w} {o}|{o}: {o} {w}
order {d}|serial {u}|, serial {u}.|S/N {u}|part number {u}|chip {u}|batch {u}|revision {u}|model {u}|MAC base {k}:{k}:{k}, serial {u}.|device {u}|ISBN {d}|{d} Hz|{W}’s {W} bridge runs|Unless {W} reads {d}|{k} MHz {N} für {w}|{W} Ltd|Tax ID|ID Card|{W} SPI bus|In {W} de {w}|Le {N} de {W}|El {N} {W} de la {w}|The {W} of {W}|{W} und {W}|{N} in {W} {k}|Am {N} {k}|{N} {k}|{W} {k}|{W} {W} {k}|{k} {N}|{k} {W} {N}|Rev {k}|Board {W} {k}|{k}, {W} {N}|Monday {W}|{k} May|January {k}|Version {k} Release Notes|Read The Manual|DO NOT {W}|{k} x {W} {N}|The {N} of {W} {N}|{E} {E} {w} {W}|{w} {E} {E} {w}|{E} {W} {w}|{w} {E} {W} {w}|mode {k}, {w}’s {W} runs|mode {k}, {W} {W}|{k} °C {w}|{k} °C {o}|{k} µs {N} für {W}|{k} °C 에서 {w} {o}|{o} {W}까지 {o}|{W}- {N} hält größere {N} zurück|{N} {W} schützt früher|Le {N} {w} règle à {k} °C|Là, {W} démarre après {w}|{W} más allá de {w} según {N}|{k} MS {W} TIME|THE {W} {W} HOLDS A {k} NS {W} {W}.""".replace("\n", "|").split("|")
FOREIGN = [p for p in PHRASES if not p.isascii() or "{o}" in p]
# Technical nouns that are capitalised in German or in headings.
NOUNS = "Regler Wandler Schalter Netzteil Speicher Zähler Takt Puffer Schnittstelle Treiber Filter Kühler Fenster Messung Steuerung Leitung Spannung Brücke Lüfterregler Taktbaum Speicherbank Busverteiler Prüfung Löschvorgang Controller Sensor Board Timer Interface Driver Overview Settings Vorhalt Spannungswächter Zeitgeber Störfilter Overflow Notes Manual Budget Passage Error Moved Power Reset Clock Layer Gehäuse Deckel Gehäuserahmen Prüfstecker Zählerkette Rückleitung Stecker Platine".split()
# Words that begin sentences.
STARTS = "The A An Each Every Our Its If Because While When After Before Until Unless In On At For With Only Der Die Das Ein Wenn Bei Le La Un Une Si El Los Una Cuando".split()
# Korean words that look like names.
KOREAN_WORDS = "신호가 수위가 장치는 이상은 전원은 신호선 기준값 제어기 보상기 회로는 영역은 주기는 온도계 정지시 전화기 조정기 구간은 설정은 주소지 한계는 전류는 전압은 감지기 진동수 정수기 유지시 이후로 채널은 잠금은 상태는 인터럽트 레지스터 출력을 응답을 버퍼를 보호 회로 구간 전환 준비 부트 로더 감시 온도 여유 요청 해제 차단 이내 동안 이상 이하 사이에 수신 송신 장치 신호 측정값 결과는 구성 전원 기준 한다 된다 않는다 유지한다 감시한다 차단한다 해제한다 지연한다 확인한다 끝나면 동안만 이후에만 에서 까지 부터 에게 으로 보다 처럼 만큼".split()
KOREAN_ENDINGS = "이 가 은 는 을 를 에 의 로 도 과 와 한다 된다 하면 하고 에서 까지".split()
# Things named after people.
THINGS = "Bessel filter|Schottky diode|Hall sensor|Fourier transform|Zener diode|Peltier element|Nyquist rate|Hamming code|Gray code|Faraday cage|Laplace transform|Planck constant|Bode plot|Carnot cycle|Geiger counter|Tesla coil|Doppler shift|Venturi tube|Turing machine|Gauss meter".split("|")
_SOUNDS = ["b d f g h j k l m n p r s t v w y z".split() + ["ch", "sh", "th", "kw", "br", "tr", "ny"], "a e i o u".split() + ["aa", "ia", "ei", "ou"], ["", "", "n", "l", "r", "s", "m", "sh", "k"]]
_PARTICLES = "van der|van|von|de|de la|da|di|bin|al|ter|zu|del|le|dos|van den".split("|")


class _Composer:
    """Composes labelled sentences; the same seed gives the same ones."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice("bdfgklmnprstvz") + self.r.choice("aeiou") for _ in range(self.r.randint(2, 3))) + self.r.choice("klmnrst")

    def digits(self, shape: str) -> str:
        return re.sub("9", lambda m: str(self.r.randint(0, 9)), shape)

    def made(self) -> str:
        """A name of two or three syllables that no list holds."""
        return "".join(self.r.choice(p) for _ in range(self.r.randint(2, 3)) for p in _SOUNDS).capitalize()

    def family(self) -> str:
        form = self.r.random()
        if form < 0.3:
            one = self.made()
        else:
            one = (self.word()[: self.r.randint(3, 5)] + self.r.choice(ENDINGS)).capitalize()
        if form > 0.95:
            one = self.r.choice(["O'", "O’", "D'", "Mc", "Mac"]) + one
        return f"{one}-{self.family()}" if self.r.random() < 0.15 else one

    def given(self) -> str:
        one = self.r.choice(GIVEN) if self.r.random() < 0.6 else self.made()
        return f"{one}-{self.given()}" if self.r.random() < 0.06 else one

    def name(self) -> str:
        form = self.r.random()
        if form < 0.17:
            length = self.r.choice([1, 2, 2, 2, 2, 2, 3])
            return self.r.choice(KOREAN_FAMILY) + "".join(self.r.choice(KOREAN_GIVEN) for _ in range(length))
        initial = f"{self.r.choice('ABCDEFGHKLMPRST')}. " if self.r.random() < 0.2 else f"{self.given()} " if self.r.random() < 0.05 else ""
        particle = f"{self.r.choice(_PARTICLES)} " if self.r.random() < 0.1 else ""
        return f"{self.given()} {initial}{particle}{self.family()}"

    def email(self) -> str:
        family, given = (re.sub(r"[^a-z]", "", w.lower()) or "x" for w in (self.family(), self.given()))
        local = self.r.choice([family, f"{given}.{family}", f"{given}-{family}", f"{given[0]}{family}", f"{given}_{family}{self.digits('99')}", f"{family}+{self.word()}"])
        host, top = self.word(), self.r.choice(["example", "example.com", "example.org", "test", "invalid", "com", "de"])
        form = self.r.random()
        if form < 0.7:
            text = f"{local}@{host}.{top}"
            return text.upper() if form < 0.06 else text
        if form < 0.85:
            return f"{local} [at] {host}.{top}"
        return f"{local} (at) {host} (dot) {top.replace('.', ' (dot) ')}"

    def phone(self) -> str:
        return self.digits(self.r.choice(
            ["+99 99 9999 9999", "+9 999 999 9999", "+9-999-999-9999", "+9 (999) 999-9999", "+99 99 99999 999", "+99 (0)999 9999999", "+99 9 99 99 99 99",
             "(999) 999-9999", "999.999.9999", "099/99999999", "09 99 99 99 99", "099-9999-9999", "09-999-9999", "09999 999999", "+99 999 9999999", "(+99) 99 999 9999", "09 99 99 99 99", "+99-9-9999-9999"]))

    def identity(self) -> str:
        shape = self.r.choice(
            ["999-99-9999", "999999-9999999", "00 999 999 999", "A99A99999", "99 999 999 999", "AA9999999", "A9999999A", "999999-9999999", "999-99-9999", "99999999A", "AA99 9999 9999 9999 9999 99", "999 999 999"])
        return re.sub("A", lambda m: self.r.choice("CFGHJKLMNPRTVWXYZ"), self.digits(shape))

    def street(self) -> str:
        n = str(self.r.randint(1, 240)) + (self.r.choice("aABbCc") if self.r.random() < 0.1 else "")
        base = self.word().capitalize() if self.r.random() < 0.6 else self.family() if self.r.random() < 0.5 else f"{self.word().capitalize()} {self.word().capitalize()}"
        joined = self.word().capitalize() + self.r.choice(["straße", "weg", "platz", "gasse", "allee", "strasse", "ring", "ufer", "damm", "str."])
        behind = f"{n} {base} {self.r.choice([s for s in STREETS_BEHIND if s not in ('Ave', 'St', 'Rd')])}"
        return self.r.choice([
            behind, behind, behind,
            f"{joined} {n}",
            f"{joined} {n}",
            f"{base.split(' ')[0]}{self.r.choice(['-', ' '])}{self.r.choice(['Straße', 'Weg', 'Platz', 'Allee'])} {n}",
            f"{n}{self.r.choice(['', ',', ' bis,', ' ter'])} {self.r.choice(STREETS_BEFORE[:9])} {self.r.choice(['', 'de ', 'du ', 'de la '])}{base}",
            f"{n} {self.r.choice(['rue', 'avenue', 'chemin', 'boulevard', 'quai'])} {self.r.choice(['', 'de '])}{base}",
            f"{self.r.choice(['Calle', 'Avenida', 'Paseo', 'Plaza', 'Camino', 'Rua', 'Via'])} {self.r.choice(['', 'de ', 'de la ', 'del '])}{base}{self.r.choice([',', ', n.º', ''])} {n}",
        ])

    def number(self) -> str:
        if self.r.random() < 0.3:
            return self.r.choice("--- .").join(self.digits("9" * self.r.randint(2, 5)) for _ in range(self.r.randint(2, 4)))
        return self.digits(self.r.choice(
            ["999-999-999", "9999-99-9999", "9 999 999", "99 999 999", "9999999999", "999999999", "999.9-999-999", "9999-99-99/999", "99999999", "199-999-999.9", "999-9999-999", "99.9999.999", "99:99:99", "9999", "99 999"]))

    def korean(self) -> str:
        """A Korean word that is no name: a known one, or any syllables with a particle."""
        if self.r.random() < 0.4:
            return self.r.choice(KOREAN_WORDS)
        stem = "".join(chr(0xAC00 + self.r.randrange(11_172)) if self.r.random() < 0.5 else self.r.choice(KOREAN_FAMILY + KOREAN_GIVEN) for _ in range(self.r.randint(1, 3)))
        return stem + self.r.choice(KOREAN_ENDINGS)

    def serial(self) -> str:
        shape = self.r.choice(["SN99999999999", "SN999999999", "AA99999999", "A99A99999", "AA9999999", "99999999999", "AAA9999999", "99-9999999", "9999-9999-9999", "S9999999"])
        return re.sub("A", lambda m: self.r.choice("BCDKMPRX"), self.digits(shape))

    def garbled(self) -> Callable[[str], str]:
        """What a text looks like that was written in one encoding and read in another, or in capitals only."""
        form = self.r.random()
        if form < 0.08:
            written, read = self.r.choice([("utf-8", "cp1252"), ("utf-8", "cp1251"), ("utf-8", "cp437"), ("utf-8", "mac-roman"), ("cp1252", "cp437"), ("cp1252", "cp1251")])
            return lambda text: text.encode(written, "ignore").decode(read, "ignore")
        return str.upper if form < 0.11 else str

    def sentence(self) -> tuple[str, set[Segment]]:
        line, gold = self.r.choice(["", "", "/* ", " * ", "# ", "> ", '    "', "The supply is held. ", f"{self.word()} "]), set()
        changed = self.garbled()
        made = {
            "{n}": ("name", self.name), "{e}": ("email", self.email), "{p}": ("phone", self.phone), "{i}": ("id_number", self.identity),
            "{s}": ("street_address", self.street), "{w}": ("", self.word), "{d}": ("", self.number), "{k}": ("", lambda: str(self.r.randint(1, 10 ** self.r.randint(1, 4)))),
            "{v}": ("", lambda: self.digits(self.r.choice(["9.9.9", "9.99.9", "99.9999.999"]))), "{W}": ("", lambda: self.word().capitalize() if self.r.random() < 0.8 else self.word().upper()),
            "{T}": ("", lambda: self.r.choice(THINGS)), "{u}": ("", self.serial), "{o}": ("", self.korean), "{N}": ("", lambda: self.r.choice(NOUNS)),
            "{S}": ("", lambda: self.r.choice(STREETS_BEHIND)), "{E}": ("", lambda: self.r.choice(STARTS)),
        }
        for phrase in self.r.choices(FOREIGN if changed not in (str, str.upper) and self.r.random() < 0.7 else PHRASES, k=2 if self.r.random() < 0.25 else 1):
            for part in re.split(r"(\{\w\})", phrase + " "):
                kind, make = made.get(part, ("", lambda part=part: part))
                text = changed(make())
                if kind:
                    gold.add((len(line), len(line) + len(text), kind))
                line += text
        return line.rstrip(), gold


def sentences(count: int, seed: int) -> list[tuple[str, set[Segment]]]:
    composer = _Composer(seed)
    return [composer.sentence() for _ in range(count)]


@cache
def model(count: int = 14_000, seed: int = 1) -> SemiMarkovCRF:
    """The field trained on ``count`` composed sentences; trained once a process."""
    return SemiMarkovCRF.fit(sentences(count, seed))


def masked(text: str, segments: list[Segment]) -> str:
    """The text with each segment replaced by a placeholder of its type."""
    for a, b, kind in sorted(segments, reverse=True):
        text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
    return text


def personal_data(documents: DataFrame, field: SemiMarkovCRF | None = None) -> DataFrame:
    """``doc_id, pii_type, pii_text, start``: every find in each non-null text; ``start`` counts code points from 0.

    Whole texts are searched where they are read; only the field's weights are sent out. Texts without any give no row.
    """
    shared = documents.sparkSession.sparkContext.broadcast(field or model())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (d, kind, text[a:b], a)
                for d, text in zip(batch.doc_id, batch.text, strict=True)
                if text
                for a, b, kind in shared.value.decode(text)
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "pii_type", "pii_text", "start"])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, pii_type string, pii_text string, start int")


def without_personal_data(documents: DataFrame, field: SemiMarkovCRF | None = None) -> DataFrame:
    """``documents`` with every find in ``text`` replaced by its placeholder; null texts stay null."""
    shared = documents.sparkSession.sparkContext.broadcast(field or model())

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: masked(t, shared.value.decode(t)) if t else t)

    return documents.withColumn("text", mask("text"))

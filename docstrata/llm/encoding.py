"""Text decoded with the wrong character encoding: found and restored by noisy-channel decoding.

A piece is a run of letters and non-ASCII characters with a little of what stands around it. For each encoding it may
have been read in, a piece gives a lattice of bytes (lost characters are wildcards); for each encoding it may have been
written in, a Viterbi search over that lattice gives the texts it may stand for, and the corpus' word frequencies choose
among them: those of known words by a join on what is not lost, each checked against the lattice, those of unknown words
under character weights. A text is believed if the whole corpus writes it much more often than what stands there, or if its
bytes fit the stricter encoding as chance would hardly have it; lost bytes only if the best text is much likelier than the
second.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from heapq import merge
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.common import cut_lineage, small_side

RUN = re.compile(r"[A-Za-z]*[^\x00-\x7f][A-Za-z\x80-\U0010ffff]*")
#: Signs that any word may take; letters that are not beside them say nothing on the encoding.
SIGNS = "’“”–"
_PLAIN = re.compile(rf"[A-Za-z{SIGNS}]+")
_FAR = re.compile(r"(?<![A-Za-z])[A-Za-z]+(?=[A-Za-z])")
LOST, BOM = "�", "\ufeff"
CONTROL = re.compile(r"[\x80-\x9f]")
#: Encodings (Python's names) a text may have been read in, and written in.
READ_AS = ("latin-1", "cp1252", "cp437", "cp850", "mac_roman", "cp1251", "cp949")
WRITTEN_IN = ("utf-8", "cp1252", "cp437", "cp850", "mac_roman", "cp949")
#: Log odds a restored piece needs: as a sign of single bytes, else.
SIGN_ODDS, WORD_ODDS = math.log(50), math.log(12)
#: Log odds against chance of each byte that fits UTF-8, in single-byte readings and in cp949's, and that fits Hangul.
FITS, FITS_949, FITS_HANGUL = 1.4, 1.0, 0.5
#: Log odds of a byte order mark, which nobody writes letter by letter.
BOM_ODDS = 8.0
#: Letters of a word that is believed against any number of its damaged form, if the corpus has it and its bytes fit UTF-8.
SURE = 3
HANGUL = re.compile("[가-힣]")
WORDS = re.compile(r"[^\W\d_]{4}|[가-힣]{2}")
#: Texts kept of a lattice with lost bytes: as many as one lost byte of UTF-8 has values.
PATHS = 64
#: How many times as frequent as the second best text the best must be to fill lost bytes.
MARGIN = 4.0
#: Pieces that one task reads; the number of tasks grows with the pieces.
PIECES_PER_TASK = 2_000
#: Distinct characters that may be held in memory: Unicode has not so many.
CHARACTERS = 0x110000


def _class(c: str) -> str:
    return "é" if c > "\x7f" else "0" if c.isdigit() else "a" if c.isalpha() else c if c > " " else " "


def pieces(text: str, start: int = 0, end: int | None = None) -> Iterator[str]:
    """Each piece between ``start`` and ``end`` as ``left|run|right``: the classes of up to two characters around the run."""
    n = len(text)
    for m in RUN.finditer(text, start, n if end is None else end):
        a, b = m.span()
        left = _class(text[a - 1]) if a else " "
        if left == " " and a > 1:
            left = _class(text[a - 2]) + left
        right = _class(text[b]) if b < n else " "
        if right == " " and b + 1 < n:
            right += _class(text[b + 1])
        run = m[0]
        if _PLAIN.fullmatch(run):
            run = _FAR.sub("", re.sub(r"(?<=[A-Za-z])[A-Za-z]+(?![A-Za-z])", "", run) if run[0] in SIGNS else run)
        yield f"{left}|{run}|{right}"


def key(piece: str) -> str:
    """What the corpus counts of a piece: a word in lower case alone, a shorter run with what stands around it."""
    left, run, right = split(piece)
    if WORDS.search(run):
        return run.lower()
    return f"{left[-1:] if len(run) > 2 else left}|{run.lower()}|{right[:1] if len(run) > 2 else right}"


def split(piece: str) -> tuple[str, str, str]:
    left, rest = piece.split("|", 1) if piece[0] != "|" else ("|", piece[2:])
    run = RUN.search(rest)[0] if RUN.search(rest) else rest.split("|", 1)[0]
    return left, run, rest[len(run) + 1 :]


def lattice(run: str, read_as: str) -> list[bytes | None] | None:
    """The bytes behind each character, None for a lost one; None if ``read_as`` can't have given the run."""
    out: list[bytes | None] = []
    for c in run:
        if c == LOST:
            out.append(None)
            continue
        try:
            out.append(c.encode(read_as))
        except UnicodeEncodeError:
            if read_as == "cp1252" and CONTROL.match(c):  # its undefined bytes are kept as they are
                out.append(bytes([ord(c)]))
            else:
                return None
    return out


def _ordinary(text: str, boxes: bool = False) -> bool:
    """Whether a text holds only what people write: no controls, nothing unassigned, and line drawing only if ``boxes``."""
    return all(
        c < "\x7f" or c == BOM or (unicodedata.category(c)[0] in "LMNPSZ" and (boxes or not "─" <= c <= "▟") and c != LOST) for c in text
    )


class Characters:
    """Character weights (log probabilities) by the bytes a character has in an encoding; each window is looked up once."""

    def __init__(self, weight: dict[str, float]):
        self.weight = weight
        self.coded: dict[str, dict[int, list[tuple[str, bytes]]]] = {}
        self.held: dict[tuple[str, int, int, int], list[tuple[str, bytes]]] = {}
        self.found: dict[tuple[str, tuple[int | None, ...]], list[tuple[str, float]]] = {}

    def lengths(self, written_in: str) -> dict[int, list[tuple[str, bytes]]]:
        if written_in not in self.coded:
            coded = self.coded[written_in] = {1: []}
            for c in sorted(self.weight, key=lambda c: (-self.weight[c], c)):
                try:
                    b = c.encode(written_in)
                except UnicodeEncodeError:
                    continue
                coded.setdefault(len(b), []).append((c, b))
                for i, x in enumerate(b):
                    self.held.setdefault((written_in, len(b), i, x), []).append((c, b))
        return self.coded[written_in]

    def fitting(self, written_in: str, window: tuple[int | None, ...]) -> list[tuple[str, float]]:
        """The PATHS likeliest characters that agree with the known bytes of ``window``, likeliest first."""
        if len(window) == 1 and window[0] is not None and window[0] < 128:
            return [(chr(window[0]), -3.0)]
        if (found := self.found.get((written_in, window))) is None:
            known = [(i, x) for i, x in enumerate(window) if x is not None]
            lists = [self.held.get((written_in, len(window), i, x), []) for i, x in known]
            chars = min(lists, key=len) if lists else self.lengths(written_in).get(len(window), [])
            fits = ((c, self.weight[c]) for c, b in chars if all(b[i] == x for i, x in known))
            if len(self.found) > 100_000:
                self.found.clear()
            found = self.found[written_in, window] = list(islice(fits, PATHS))
        return found


def paths(nodes: list[bytes | None], written_in: str, chars: Characters) -> list[str]:
    """The PATHS likeliest texts of a byte lattice under character weights, likeliest first; wildcards stand for one byte.

    Without wildcards only one text fits. With them each place keeps the best texts up to it, over all characters whose
    bytes in ``written_in`` agree with the known bytes there.
    """
    if None not in nodes:
        try:
            return [b"".join(nodes).decode(written_in)]  # type: ignore[arg-type]
        except UnicodeDecodeError:
            return []
    cells: list[int | None] = [b for n in nodes for b in ([None] if n is None else n)]
    lengths = chars.lengths(written_in)

    def longer(before: tuple[float, str], options: list[tuple[str, float]]) -> Iterator[tuple[float, str]]:
        return ((before[0] + w, before[1] + c) for c, w in options)

    best: list[list[tuple[float, str]]] = [[(0.0, "")]]
    for j in range(1, len(cells) + 1):
        options = {n: chars.fitting(written_in, tuple(cells[j - n : j])) for n in lengths if n <= j and best[j - n]}
        more = [longer(before, found) for n, found in options.items() if found for before in best[j - n]]
        best.append(list(islice(merge(*more, key=lambda x: -x[0]), PATHS)))
    return [text for _, text in best[-1]]


def viterbi(nodes: list[bytes | None], written_in: str, weight: dict[str, float]) -> str | None:
    """The likeliest of ``paths``."""
    return next(iter(paths(nodes, written_in, Characters(weight))), None)


def _attested(text: str, nodes: list[bytes | None], written_in: str) -> int:
    """How many known bytes of a lattice stand in the non-ASCII characters of ``text``, a path through it."""
    cells = [x is not None for n in nodes for x in ([None] if n is None else n)]
    at = known = 0
    for c in text:
        n = len(c.encode(written_in))
        known += sum(cells[at : at + n]) if c > "\x7f" else 0
        at += n
    return known


def readings(piece: str, chars: Characters) -> list[tuple[str, str, float]]:
    """``(text, channel, odds)`` of each text a damaged piece may have had, once or twice misread.

    Lost bytes are no evidence for any reading: they give no odds, and a run of nothing but lost bytes has no readings.
    """
    left, run, right = split(piece)
    found: dict[str, tuple[str, float]] = {}
    for read_as in READ_AS:
        nodes = lattice(run, read_as)
        if nodes is None or not any(nodes):
            continue
        for written_in in WRITTEN_IN:
            if written_in == read_as or LOST in run and written_in == "cp949" and read_as != "latin-1":
                continue
            for text in paths(nodes, written_in, chars):
                if text == run or not _ordinary(text, written_in == "utf-8"):
                    continue
                odds = 0.0
                if written_in == "utf-8":
                    odds = (FITS_949 if read_as == "cp949" else FITS) * _attested(text, nodes, written_in)
                    odds += BOM_ODDS * (BOM in text and LOST not in run)
                elif written_in == "cp949":
                    odds = FITS_HANGUL * (_attested(text, nodes, written_in) if LOST in run else 2 * len(HANGUL.findall(text)))
                if odds > found.get(text, ("", -1.0))[1]:
                    found[text] = (f"{written_in}>{read_as}", odds)
                if written_in == "utf-8" and LOST not in run:
                    for again in READ_AS[:2]:
                        inner = lattice(text, again)
                        for twice in paths(inner, "utf-8", chars) if inner else []:
                            if twice != text and _ordinary(twice):
                                found[twice] = (f"utf-8>{again}>{read_as}", odds + 2.0)
    return [(t, channel, odds) for t, (channel, odds) in found.items()]


def _piece_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        count: Counter[str] = Counter()
        distinct: Counter[str] = Counter()
        for text, copies in zip(batch.text, batch.copies, strict=True):
            found = set(pieces(text))
            distinct.update(found)
            count.update(dict.fromkeys(found, copies))
        yield pd.DataFrame([(p, n, distinct[p]) for p, n in count.items()], columns=["piece", "n", "d"])


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"key": batch.piece.map(key), "n": batch.n, "d": batch.d}).groupby("key", as_index=False).sum()


def _masked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words by what ASCII holds of them: ``piece`` where bytes of the rest are lost, ``known`` where none are."""
    for batch in batches:
        rows = []
        for piece, n in zip(batch.piece, batch.n, strict=True):
            run = split(piece)[1]
            mask = re.sub(r"[^\x00-\x7f]+", LOST, run.lower())
            if re.search(r"[a-z].*[a-z]", mask) and (LOST in run or not CONTROL.search(run)):
                known = run.lower() if LOST not in run else None
                rows.append((mask, None if known else piece, known, run, n))
        yield pd.DataFrame(rows, columns=["mask", "piece", "known", "run", "n"], dtype=object)


def cased(word: str, run: str) -> str:
    """A word in lower case in the case of the run it restores."""
    return word.upper() if run.isupper() and len(run) > 1 else word.capitalize() if run[0].isupper() else word


def stands_for(run: str, word: str) -> bool:
    """Whether ``word`` is a path through one of the byte lattices of ``run``: as many bytes, the known ones alike."""
    for read_as in READ_AS:
        nodes = lattice(run, read_as)
        if nodes is None:
            continue
        cells = [b for n in nodes for b in ([None] if n is None else n)]
        for written_in in WRITTEN_IN:
            if written_in != read_as:
                try:
                    coded = word.encode(written_in)
                except UnicodeEncodeError:
                    continue
                if len(coded) == len(cells) and all(x is None or x == y for x, y in zip(cells, coded, strict=True)):
                    return True
    return False


def _standing(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The candidate words that stand in a lattice of their piece, in its case."""
    for batch in rows:
        found = [
            (piece, word, n)
            for piece, known, run, n in zip(batch.piece, batch.known, batch.run, batch.n, strict=True)
            if stands_for(run, word := cased(known, run))
        ]
        yield pd.DataFrame(found, columns=["piece", "filled", "n"])


def _filled(counts: DataFrame, damaged: DataFrame) -> DataFrame:
    """``piece, filled``: lost pieces with the corpus' most frequent word among the paths of their byte lattices.

    This is the search through the lattices under word frequencies: words meet pieces by what ASCII holds of both, and those
    that are no path are left out. A word that isn't MARGIN times as frequent as the second fills nothing, nor does one
    that is ``damaged`` itself.
    """
    masks = counts.join(small_side(damaged.select("piece")), "piece", "left_anti").select("piece", "n").mapInPandas(_masked, "mask string, piece string, known string, run string, n long")
    words = masks.where("known IS NOT NULL").groupBy("mask", "known").agg(F.sum("n").alias("n"))
    lost = masks.where("piece IS NOT NULL").select("mask", "piece", "run")
    found = lost.join(words, "mask").select("piece", "known", "run", "n").mapInPandas(_standing, "piece string, filled string, n long")
    return _by_margin(found, F.log("n")).select("piece", "filled")


def _by_margin(found: DataFrame, score: Column) -> DataFrame:
    """Of the rows of each ``piece`` the one of the greatest ``score``, if that is MARGIN times as likely as the second."""
    by = Window.partitionBy("piece").orderBy(F.desc("_score"))
    rows = found.withColumn("_score", score).withColumn("_rank", F.row_number().over(by)).where(F.col("_rank") <= 2)
    second = F.lead("_score").over(by)
    return rows.withColumn("_second", second).where((F.col("_rank") == 1) & (F.col("_second").isNull() | (F.col("_score") - F.col("_second") >= math.log(MARGIN))))


def _piece_rows(id_type: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (i, p) for i, text in zip(batch.id, batch.text, strict=True) if text is not None and not text.isascii() for p in set(pieces(text))
            ]
            yield pd.DataFrame(rows, columns=["id", "piece"])

    return run, f"id {id_type}, piece string"


def damaged_pieces(texts: DataFrame) -> DataFrame:
    """``piece, restored, channel``: the pieces of ``texts`` (``text``) that only a wrong decoding explains.

    ``restored`` and ``channel`` are null where nothing believable was found. Pieces are counted over all texts and over all
    distinct texts, and the count that speaks more for a reading holds, so that copies don't argue for their own damage
    (partial counts per batch; non-ASCII texts are shuffled once by their copies). Candidate readings are made once per
    distinct piece and joined with those counts. Null, empty and ASCII texts have no pieces; no texts give no rows.
    """
    counts = cut_lineage(
        texts.where(F.col("text").rlike(r"[^\x00-\x7f]"))
        .groupBy("text")
        .agg(F.count(F.lit(1)).alias("copies"))
        .mapInPandas(_piece_counts, "piece string, n long, d long")
        .groupBy("piece")
        .agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    )
    chars = (
        counts.select("n", F.explode(F.split("piece", "")).alias("c")).where("c > '\x7f'").groupBy("c").agg(F.sum("n").alias("n")).limit(CHARACTERS)
    )
    held = {r.c: r.n for r in chars.collect() if r.c != LOST and not CONTROL.match(r.c)}
    total = sum(held.values()) or 1
    shared = counts.sparkSession.sparkContext.broadcast({c: math.log(n / total) for c, n in held.items()})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chars = Characters(shared.value)
        for batch in batches:
            rows = []
            for piece, n in zip(batch.piece, batch.n, strict=True):
                left, run, right = split(piece)
                lost = LOST in run or CONTROL.search(run) is not None
                rows.append((piece, n, lost, None, None, 0.0, key(piece), True, False))
                for text, channel, odds in readings(piece, chars):
                    word = WORDS.search(text) is not None
                    sure = channel.startswith("utf-8") and LOST not in run and sum(map(str.isalpha, text)) >= SURE
                    rows += [(piece, n, lost, text, channel, odds, key(p), word, sure) for p in pieces(left + text + right, len(left), len(left + text))]
            yield pd.DataFrame(rows, columns=["piece", "n", "lost", "restored", "channel", "odds", "key", "word", "sure"])

    schema = "piece string, n long, lost boolean, restored string, channel string, odds double, key string, word boolean, sure boolean"
    tasks = min(20_000, max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), counts.count() // PIECES_PER_TASK))
    read_out = counts.repartition(tasks).mapInPandas(read, schema)
    keys = counts.mapInPandas(_keyed, "key string, n long, d long").groupBy("key").agg(F.sum("n").alias("known"), F.sum("d").alias("known_once"))
    scored = cut_lineage(
        read_out.join(keys, "key", "left")
        .groupBy("piece", "restored")
        .agg(
            F.max("lost").alias("lost"),
            F.first("channel").alias("channel"),
            F.max("odds").alias("odds"),
            F.min("word").alias("word"),
            F.min("sure").alias("sure"),
            F.min(F.coalesce("known", F.lit(0))).alias("known"),
            F.min(F.coalesce("known_once", F.lit(0))).alias("known_once"),
        )
    )
    here = scored.where("restored IS NULL").select("piece", F.col("known").alias("here"), F.col("known_once").alias("here_once"), "lost")
    share = lambda known, here: F.log(F.col(known) + 0.5) - F.log(F.col(here) + 0.5)
    likely = (
        scored.where("restored IS NOT NULL")
        .drop("lost")
        .join(here.drop("lost"), "piece")
        .withColumn("score", F.greatest(share("known", "here"), share("known_once", "here_once")) + F.col("odds"))
        .withColumn("sign", ~F.col("word") & ~F.col("channel").startswith("utf-8"))
        # What fills lost bytes must itself be known: nothing else tells it from an invention.
        .where((F.col("known") > 0) | ~F.col("piece").contains(LOST))
        .where((F.col("sure") & (F.col("known") > 0)) | (F.col("score") >= F.when(F.col("sign"), F.lit(SIGN_ODDS)).otherwise(F.lit(WORD_ODDS))))
    )
    # A sign of single bytes counts only where its channel has damaged words too: at most one row a pair of encodings.
    channels = likely.where("word").groupBy("channel").agg(F.lit(True).alias("seen"))
    seen = likely.join(F.broadcast(channels), "channel", "left").where("seen OR NOT sign")
    whole = seen.where(~F.col("piece").contains(LOST)).groupBy("piece").agg(F.max_by(F.struct("restored", "channel"), F.struct("score", "restored")).alias("best"))
    torn = _by_margin(seen.where(F.col("piece").contains(LOST)), F.col("score")).select("piece", F.struct("restored", "channel").alias("best"))
    best = cut_lineage(whole.union(torn).select("piece", "best.restored", "best.channel"))
    return (
        here.join(best, "piece", "left")
        .where("lost OR restored IS NOT NULL")
        .join(_filled(counts, best.where(~F.col("piece").contains(LOST))), "piece", "left")
        .select("piece", F.coalesce("restored", "filled").alias("restored"), F.when(F.col("restored").isNull() & F.col("filled").isNotNull(), "lost bytes").otherwise(F.col("channel")).alias("channel"))
    )


def damaged_records(texts: DataFrame, damage: DataFrame) -> DataFrame:
    """``id, piece, restored, channel``: one row per record of ``texts`` (``id, text``) and damaged piece in it."""
    run, schema = _piece_rows(dict(texts.dtypes)["id"])
    return texts.select("id", "text").mapInPandas(run, schema).join(small_side(damage), "piece")


def restored(texts: DataFrame, damage: DataFrame) -> DataFrame:
    """``id, text, lost``: the damaged records of ``texts`` (``id, text``) with every restorable piece put right.

    ``lost`` tells whether damage is left that nothing explains; it stays as it stands. Each record's few pieces are
    grouped by id and joined back to its text; rows that share an id must share their text.
    """
    found = (
        damaged_records(texts, damage)
        .groupBy("id")
        .agg(F.collect_set(F.struct("piece", "restored")).alias("pieces"), F.max(F.col("restored").isNull()).alias("lost"))
    )

    def put_right(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for text, known in zip(batch.text, batch.pieces, strict=True):
                right = {p["piece"]: p["restored"] for p in known if p["restored"] is not None}
                at, out = 0, []
                for m, piece in zip(RUN.finditer(text), pieces(text), strict=True):
                    if piece in right:
                        # A collapsed piece keeps only the letters next to its signs: the others stand in the run itself.
                        out += [text[at : m.start()], _expand(m[0], split(piece)[1], right[piece])]
                        at = m.end()
                done.append("".join(out) + text[at:])
            yield pd.DataFrame({"id": batch.id, "text": done, "lost": batch.lost})

    kind = dict(texts.dtypes)["id"]
    some = texts.where(F.col("text").rlike(r"[^\x00-\x7f]")).select("id", "text").join(small_side(found), "id").dropDuplicates(["id"])
    return some.select("id", "text", "pieces", "lost").mapInPandas(put_right, f"id {kind}, text string, lost boolean")


def _expand(run: str, short: str, right: str) -> str:
    """``right``, the reading of ``short``, with what collapsing took from the ends of ``run``."""
    at = run.find(short)
    return right if at < 0 else run[:at] + right + run[at + len(short) :]

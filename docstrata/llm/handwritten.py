"""Files that nobody on the project wrote by hand: linear support-vector classifiers over paths, lines and bodies.

Three classifiers, each trained here on a bounded sample that seed rules label: one on path components and their hashed
character n-grams, one on lines (does the line give the file away?), one on the hashed character n-grams of the body with
such lines masked, so that it has to learn how generated, minified and blob content looks without its header. Seeds are
conventions by which tools and people commonly mark such files; everything is then judged by the classifiers, and a file
is found if any of the three says so.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstrata.common import cut_lineage

#: Hashed features.
DIMENSIONS = 1 << 18
#: Bounds of the training sample: rows of each seed of a path, other paths, documents, lines of these.
PER_SEED, OTHER_PATHS, TEXTS, LINES = 300, 12_000, 6_000, 40_000
PENALTY, EPOCHS = 10.0, 12
#: What a body's margin must reach: the few lines of a file cut short say little.
BODY_MARGIN = 0.25

# Seeds. Folders in which projects keep what others wrote or tools made, and names that tools give.
SEED_FOLDERS = (
    "vendor vendors vendored third-party third_party thirdparty 3rd-party 3rd_party 3rdparty external externals extern deps node_modules bower_components "
    "pods carthage dist-packages site-packages generated _generated autogen gen dist target"
).split()
SEED_ENDINGS = (
    r"_pb2(?:_grpc)?\.py _pb\.js \.pb\.(?:c|cc|h|go) \.tab\.[ch] \.(?:yy|lex)\.[ch] [._-]gen\.\w+ [._]generated\.\w+ [._]autogen\.\w+ [.-]min\.(?:m?js\.)*m?js "
    r"\.min\.css \.bundle\.js \.designer\.\w+ \.g\.dart"
).split()
SEED_DIRS = rf"(?i)(?:^|/)({'|'.join(SEED_FOLDERS)})/"
SEED_NAMES = rf"(?i)({'|'.join(SEED_ENDINGS)})$|(?:^|[/_])(?:moc|qrc|ui)_(?=\w+\.(?:cpp|cc|h)$)"
# How the headers of generated files speak: marks of tools, a line that begins with its making, what made it,
# the order not to edit the file, what happens to changes.
GENERATED_LINES = re.compile(
    r"@generated\b|(?i:<auto-?generated)|(?i:^\W*(?:this (?:file|code|source) (?:is|was|has been) )?(?:auto(?:matically)?|machine)[- ]?(?:generated|created|made|produced|written)\b)"
    r"|(?i:\b(?:code|files?|source|tables?) (?:(?:is|was|are|were|has been) )?(?:auto-?|automatically |machine[- ])?(?:generated|produced|created) (?:by|from|with)\b)"
    r"|\bDO NOT (?:EDIT|MODIFY|CHANGE)\b|(?i:\bdo not (?:edit|modify|change)(?: (?:it|this file|by hand|manually|directly))?\W*$)"
    r"|(?i:\b(?:manual|hand) (?:changes|edits|modifications)\b.*\b(?:lost|overwritten|discarded)\b)"
)
# How the headers of copies speak: taken over unchanged, whose distribution it is, where bugs go, the banner
# that minifiers keep.
COPIED_LINES = re.compile(
    r"(?i)\b(?:verbatim|unmodified|unchanged)\b.*\bfrom\b|\bupstream (?:licen[cs]e|release|version|project|distribution|source)\b"
    r"|\breport (?:bugs|issues|problems) to\b|^\W*/\*! \S+ v\d"
)
COMMENT = re.compile(r"(?m)^[ \t]*(?:/\*+!?|\*(?!/)|//+|#(?!include|define)|\"{3}|<!--|;|--)[ \t]*(\S.*?)[ \t]*(?:\*/|-->)?[ \t]*\r?$")


def _hash(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature) % DIMENSIONS


def path_parts(path: str) -> list[str]:
    """Folders, parts and endings of the file name, each whole and by its character n-grams, without case and separators.

    First words of file names are endless and say nothing, so only their beginning up to the first separator is dropped
    where more follows; numbers and hashes in names are one.
    """
    *folders, name = path.replace("\\", "/").lower().split("/")
    parts = re.split(r"[._-]", name)
    parts[:-1] = ["#" if re.fullmatch(r"[0-9a-f]{2,}|[a-f]*\d[0-9a-f]*", p) else p for p in parts[:-1]]
    found = {f"n:{p}" for p in parts[1:]} | {f"x:{'.'.join(parts[-k:])}" for k in (2, 3) if len(parts) > k}
    if len(parts) > 2 or parts[0] in ("moc", "qrc", "ui"):
        found.add(f"p:{parts[0] if parts[0] in ('moc', 'qrc', 'ui') else ''}")
    for folder in folders:
        plain = f"^{re.sub(r'[^a-z0-9]', '', folder)}$"
        found |= {f"d:{plain}"} | {f"{n}:{plain[i : i + n]}" for n in (4, 6) for i in range(len(plain) - n + 1)}
    return sorted(found)


def path_features(path: str) -> np.ndarray:
    return np.unique(np.array([_hash(part) for part in path_parts(path)] or [0], dtype=np.int64))


_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint64)


def gram_features(text: str, size: int = 4) -> np.ndarray:
    """The distinct hashed character n-grams of a text, in lower case and with digits alike."""
    units = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    units = np.where((units >= 48) & (units <= 57), np.uint64(48), units)
    if len(units) < size:
        return np.zeros(1, dtype=np.int64)
    mixed = sum(units[i : len(units) - size + 1 + i] * _FACTORS[i] for i in range(size))
    return np.unique((((mixed ^ (mixed >> np.uint64(15))) * np.uint64(0x2C1B3C6D)) >> np.uint64(13)).astype(np.int64) % DIMENSIONS)


def body_features(text: str) -> np.ndarray:
    """N-grams of the whole text and, as further features, how long, dense and numeric its lines are."""
    lines = text.split("\n")
    n = max(1, len(text))
    blank, digits = sum(map(str.isspace, text)) / n, len(re.findall(r"[0-9]", text)) / n
    shape = (
        f"longest:{min(8, max(map(len, lines)) // 150)}",
        f"mean:{min(12, n // len(lines) // 15)}",
        f"blank:{int(blank * 15)}",
        f"digits:{int(digits * 12)}",
        f"words:{min(20, len(set(re.findall(r'[^\W\d]{3,}', text))) * 40 // max(1, n // 8))}",
    )
    return np.concatenate([gram_features(text), [_hash(s) for s in shape]]).astype(np.int64)


@dataclass
class LinearSVM:
    """A linear support-vector machine over sets of hashed features of unit length."""

    weights: np.ndarray

    @classmethod
    def fit(cls, rows: list[np.ndarray], labels: Iterable[bool], seed: int = 0) -> LinearSVM:
        """Dual coordinate descent on the L1-loss problem; the constant feature is the last weight."""
        y = np.where(np.fromiter(labels, dtype=bool), 1.0, -1.0)
        w, alpha = np.zeros(DIMENSIONS + 1, dtype=np.float64), np.zeros(len(rows))
        scale = np.array([1 / np.sqrt(len(r)) for r in rows])
        order = np.random.default_rng(seed)
        for _ in range(EPOCHS):
            for i in order.permutation(len(rows)).tolist():
                r, s = rows[i], scale[i]
                gradient = y[i] * (w[r].sum() * s + w[-1]) - 1
                new = min(PENALTY, max(0.0, alpha[i] - gradient / 2.0))
                if new != alpha[i]:
                    step = (new - alpha[i]) * y[i]
                    w[r] += step * s
                    w[-1] += step
                    alpha[i] = new
        return cls(w.astype(np.float32))

    def margin(self, features: np.ndarray) -> float:
        return float(self.weights[features].sum() / np.sqrt(len(features)) + self.weights[-1])


def telling_lines(text: str, lang: str | None) -> list[str]:
    """The lines that speak to a reader: comments of code, all lines of prose; data have none."""
    if lang == "json":
        return []
    return COMMENT.findall(text) if lang else [line.strip() for line in text.split("\n") if line.strip()]


def _generated(line: str) -> bool:
    return GENERATED_LINES.search(line) is not None


def _gives_away(line: str) -> bool:
    return _generated(line) or COPIED_LINES.search(line) is not None


def masked(text: str) -> str:
    """The text without the comment lines that speak as headers do, and without licence lines."""
    return COMMENT.sub(lambda m: "" if _gives_away(m[1]) or "copyright" in m[1].lower() else m[0], text)


_MINIFIED = re.compile(r"[^\n]{250,}")
_BLOB_LINE = re.compile(r"\s*(?:(?:0x[0-9a-fA-F]+|\d+)\s*,?\s*){6,}|\s*[\"'][A-Za-z0-9+/=]{40,}[\"']\s*[,;]?")


def seed_body(text: str) -> bool | None:
    """Whether a body is minified or a blob; None where the seeds don't say."""
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return None
    blob = sum(_BLOB_LINE.fullmatch(x) is not None for x in lines) / len(lines)
    dense = sum(len(x) for x in lines if _MINIFIED.match(x) and x.count(" ") < len(x) / 12) / len(text)
    if blob > 0.6 or dense > 0.6:
        return True
    return None if blob > 0.2 or dense > 0.2 else False


@dataclass
class Models:
    path: LinearSVM
    line: LinearSVM
    body: LinearSVM
    #: Accuracy on repositories that training did not see, by classifier.
    held_out: dict[str, float]

    def by_path(self, path: str) -> bool:
        return self.path.margin(path_features(path)) > 0

    def gives_away(self, line: str) -> bool:
        return self.line.margin(gram_features(line)) > 0

    def by_text(self, text: str, lang: str | None) -> bool:
        if any(map(self.gives_away, telling_lines(text, lang))):
            return True
        return lang is not None and self.body.margin(body_features(masked(text))) >= BODY_MARGIN


def _fit(rows: list[tuple[str, np.ndarray, bool]]) -> tuple[LinearSVM, float]:
    """A classifier of all rows ``(repository, features, label)``, and the accuracy of one that saw 4 of 5 repositories."""
    if len({y for _, _, y in rows}) < 2:
        rows = [*rows, ("", np.array([0]), True), ("", np.array([1]), False)]
    out = [xxhash.xxh32_intdigest(repo) % 5 == 0 for repo, _, _ in rows]
    seen = [r for r, o in zip(rows, out, strict=True) if not o]
    unseen = [r for r, o in zip(rows, out, strict=True) if o]
    trial = LinearSVM.fit([f for _, f, _ in seen], [y for _, _, y in seen]) if seen and unseen else None
    right = sum((trial.margin(f) > 0) == y for _, f, y in unseen) / len(unseen) if trial else float("nan")
    return LinearSVM.fit([f for _, f, _ in rows], [y for _, _, y in rows]), right


def _thin(rows: DataFrame, n: int, total: int) -> DataFrame:
    """About twice ``n`` of ``total`` rows, those of least hash ``o``: so that what is ordered afterwards stays small."""
    share = 2 * n / max(1, total)
    return rows if share >= 1 else rows.where(F.col("o") < F.lit(int(-(2**63) + share * 2**64)))


def _sampled_texts(documents: DataFrame) -> DataFrame:
    """``repo, body, label, lines``: of up to TEXTS code files and as many of prose, half with a hint of a seed, the features of the masked
    body with its label (null: the seeds don't say), and its lines with theirs. One pass; texts stay where they are read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for repo, text, lang in zip(batch.repo, batch.text, batch.lang, strict=True):
                lines = [(line, _gives_away(line)) for line in dict.fromkeys(telling_lines(text, lang))]
                label = (any(_generated(line) for line, _ in lines) or seed_body(text)) if lang else None
                if label is False and any(away for _, away in lines):
                    label = None  # a copy's header says nothing on its body
                body = body_features(masked(text)) if label is not None else []
                out.append((repo, body, label, [{"line": x, "away": y} for x, y in lines]))
            yield pd.DataFrame(out, columns=["repo", "body", "label", "lines"])

    hint = F.col("text").rlike(r"(?i)generated|do not |machine-|automatically|verbatim|unmodified|upstream|[^\n]{250}|(?:0x[0-9a-fA-F]+, *){6}|[A-Za-z0-9+/]{60}")
    rows = documents.select("repo", "text", "lang", F.xxhash64("path", "repo").alias("o"))
    thin = _thin(rows, 8 * TEXTS, documents.count()).where("text <> ''").withColumn("hint", hint)
    rank = F.row_number().over(Window.partitionBy("hint", F.col("lang").isNull()).orderBy("o", F.md5("text")))
    some = thin.withColumn("rank", rank).where(F.col("rank") <= TEXTS // 2)
    return cut_lineage(some.select("repo", "text", "lang").mapInPandas(read, "repo string, body array<int>, label boolean, lines array<struct<line: string, away: boolean>>"))


def train(paths: DataFrame, documents: DataFrame) -> Models:
    """Models from a bounded sample of ``paths`` (``repo, path``) and ``documents`` (``repo, path, text, lang``).

    The sample takes, in the order of a hash, up to PER_SEED paths of each seed, OTHER_PATHS other paths, twice TEXTS documents
    and LINES of their lines, a third with a seed and a third near one. Everything else is only scored. What reaches the driver
    are paths, lines and feature numbers of the sample.
    """
    order = F.xxhash64("path", "repo")
    seed = F.lower(F.coalesce(F.nullif(F.regexp_extract("path", SEED_DIRS, 1), F.lit("")), F.regexp_extract("path", SEED_NAMES, 0)))
    known = paths.where("path IS NOT NULL").select("repo", "path", seed.alias("seed"), order.alias("o"))
    rank = F.row_number().over(Window.partitionBy("seed").orderBy("o", "path"))
    positive = known.where("seed <> ''").dropDuplicates(["repo", "path"]).withColumn("r", rank).where(F.col("r") <= PER_SEED)
    others = known.where("seed = ''")
    total = others.agg(F.approx_count_distinct("o").alias("n")).first().n
    negative = _thin(others, OTHER_PATHS, total).dropDuplicates(["repo", "path"]).orderBy("o", "repo", "path").limit(OTHER_PATHS)
    sample = positive.select("repo", "path", "seed").union(negative.select("repo", "path", "seed")).distinct().toPandas()
    path, path_right = _fit([(str(r.repo), path_features(r.path), r.seed != "") for r in sample.itertuples()])

    texts = _sampled_texts(documents)
    bodies = [(str(r.repo), np.array(r.body, dtype=np.int64), r.label) for r in texts.where("label IS NOT NULL").select("repo", "body", "label").toLocalIterator()]
    each = texts.select("repo", F.explode("lines").alias("l")).groupBy("l.line", "l.away").agg(F.min("repo").alias("repo"))
    # Lines that only speak of such things are few, and what the classifier has to tell from headers: a third of the sample.
    near = F.col("line").rlike(r"(?i)generat|\bedit|machine|automatic|cop(?:y|ied)|verbatim|unmodified|upstream|vendor|licen|\bbugs\b")
    place = F.row_number().over(Window.partitionBy("away", near).orderBy(F.xxhash64("line"), "line"))
    lines = each.withColumn("place", place).where(F.col("place") <= LINES // 3).select("repo", "line", "away").toPandas()
    line, line_right = _fit([(str(r.repo), gram_features(r.line), r.away) for r in lines.itertuples()])
    body, body_right = _fit(bodies)
    return Models(path, line, body, {"path": path_right, "line": line_right, "body": body_right})


def not_handwritten_paths(files: DataFrame, models: Models) -> DataFrame:
    """``id`` of the rows of ``files`` (``id, path``) whose path alone shows it; null paths show nothing."""
    shared = files.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = cache(shared.value.by_path)
        for batch in batches:
            batch = batch.dropna()
            yield batch.loc[batch.path.map(known).astype(bool), ["id"]]
            if known.cache_info().currsize > 500_000:
                known.cache_clear()

    return files.select("id", "path").mapInPandas(run, f"id {dict(files.dtypes)['id']}")


def not_handwritten_texts(documents: DataFrame, models: Models) -> DataFrame:
    """``id`` of the rows of ``documents`` (``id, text, lang``) whose text shows it, code and prose; whole texts, nothing
    shuffled. Null and empty texts show nothing."""
    shared = documents.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [shared.value.by_text(t, lang) for t, lang in zip(batch.text, batch.lang, strict=True)]
            yield batch.loc[np.array(keep, dtype=bool), ["id"]]

    return documents.where("text <> ''").select("id", "text", "lang").mapInPandas(run, f"id {dict(documents.dtypes)['id']}")

"""Column expressions on text, paths and ids; all built from Spark's own functions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accented Latin letters that keyword search folds, and what they become.
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyy"
TOKEN = r"[\p{L}\p{N}_]+"
# The units that a number may have, by quantity.
UNITS = (
    "Hz kHz MHz GHz THz mHz uHz nHz µHz",
    "bps kbps Mbps Gbps",
    "B kB MB GB",
    "s ms us ns µs",
    "V kV MV mV uV nV µV",
    "A kA MA mA uA nA µA",
    "W kW MW mW uW nW µW",
    "°C °F",
    "% mm cm rpm",
)
_UNIT = "|".join(unit for quantity in UNITS for unit in quantity.split())
_DIGITS = r"\d+(?:[.,]\d+)*(?:[eE][-+]?\d+)?"
NUMBER = rf"[-+]?(?:0x[0-9a-fA-F]+|{_DIGITS})(?:[ \t]*(?:{_UNIT}))?"


def fold(text: Column) -> Column:
    """Lower case without Latin accents; letters are exchanged one by one only in texts that have any to exchange."""
    low = F.lower(text)
    return F.when(low.rlike("[à-ÿ]"), F.translate(low, FOLD_FROM, FOLD_TO)).otherwise(low)


def fold_word(word: str) -> str:
    """``fold`` of a word at hand, as in a question."""
    return word.lower().translate(str.maketrans(FOLD_FROM, FOLD_TO))


def tokens(text: Column) -> Column:
    """The folded words of a text in order; an empty array for null."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def query_words(query: Column) -> Column:
    """Distinct words of a query in order: the first 24, without one-character words that are not ASCII alphanumeric."""
    words = F.slice(F.array_distinct(F.regexp_extract_all(query, F.lit(f"({TOKEN})"), F.lit(1))), 1, 24)
    return F.filter(words, lambda w: (F.length(w) > 1) | w.rlike("^[A-Za-z0-9]$"))


def numbers(text: Column) -> Column:
    """Distinct number tokens with their units, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1)))


def normalized(text: Column) -> Column:
    """White space runs as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]+)$", 1))


def markdown_title(text: Column, path: Column) -> Column:
    """The first level-one heading of a Markdown file, else the file's name."""
    heading = F.trim(F.regexp_extract(unix_lines(text), r"(?m)^#[ \t]+(.+)$", 1))
    return F.coalesce(F.when(extension(path).isin(".md", ".markdown"), F.nullif(heading, F.lit(""))), basename(path))


def content_id(text: Column) -> Column:
    """A UUID-shaped id from the sha256 of ``text``."""
    h = F.sha2(text, 256)
    part = lambda start, n: F.substring(h, start, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12))


def joined(*columns: Column) -> Column:
    """Columns joined by NUL, as ids are made of them; nulls count as empty."""
    return F.concat_ws("\0", *[F.coalesce(c, F.lit("")) for c in columns])


def token_estimate(text: Column) -> Column:
    """A third of the code points, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 3)).cast("long")


def embedding_input(title: Column, text: Column) -> Column:
    return F.concat(F.lit("title: "), F.coalesce(title, F.lit("")), F.lit(" | text: "), text)


def query_input(query: Column) -> Column:
    return F.concat(F.lit("task: search result | query: "), query)


def location_label(page: Column, start: Column, end: Column) -> Column:
    lines = F.when(
        start.isNotNull(), F.when(start == end, F.concat(F.lit("Line "), start)).otherwise(F.concat(F.lit("Lines "), start, F.lit("–"), end))
    )
    return F.concat_ws(" · ", F.when(page.isNotNull(), F.concat(F.lit("Page "), page)), lines)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays in double precision; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def glob_regex(pattern: str) -> str:
    """The regular expression of a path glob: ``**`` any characters, ``*`` any but ``/``, the rest literal, without case.

    A pattern of more than 512 characters matches nothing.
    """
    if len(pattern) > 512:
        return r"(?!)"
    parts = re.split(r"(\*\*|\*)", pattern.replace("\\", "/"))
    body = "".join({"**": ".*", "*": "[^/]*"}.get(p) or re.sub(r"([^\w/ ])", r"\\\1", p, flags=re.ASCII) for p in parts)
    return f"(?is)^{body}$"


def tag_regex(pattern: str) -> str:
    """The regular expression of a tag glob: ``*`` any characters, ``?`` one, case-sensitive."""
    body = "".join({"*": ".*", "?": "."}.get(c) or re.sub(r"([^\w/ ])", r"\\\1", c, flags=re.ASCII) for c in pattern)
    return f"(?s)^{body}$"


def holds_identifier(text: Column, identifiers: list[str]) -> Column:
    """Whether any identifier stands whole in the text; true if there are none."""
    if not identifiers:
        return F.lit(True)
    return text.rlike(r"(?<![A-Za-z0-9_])(?:" + "|".join(map(re.escape, identifiers)) + r")(?![A-Za-z0-9_])")


def code_identifiers(question: Column) -> Column:
    """Identifiers a question names: in backticks or before a bracket, then those in snake or camel case."""
    word = r"[A-Za-z_][A-Za-z0-9_]*"
    marked = F.filter(
        F.regexp_extract_all(question, F.lit(rf"(?<![A-Za-z0-9_])(`?{word}(?:`|\s*\()?)"), F.lit(1)),
        lambda w: w.endswith("(") | (w.startswith("`") & w.endswith("`")),
    )
    named = F.transform(marked, lambda w: F.regexp_extract(w, word, 0))
    inner = lambda w: F.length(F.replace(F.substring(w, F.lit(2), F.length(w) - 2), F.lit("_"))) < F.length(w) - 2
    humped = lambda w: F.exists(F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(w, i, F.lit(2)).rlike("^[a-z][A-Z]$"))
    plain = F.regexp_extract_all(question, F.lit(f"({word})"), F.lit(1))
    return F.array_union(named, F.filter(plain, lambda w: (inner(w) & w.rlike("[A-Za-z0-9]_[A-Za-z0-9_]")) | humped(w)))


# The names, endings and words that make a document a build description, and the endings of source code.
IMPLEMENTATION = ".c .h .cc .hh .cpp .hpp .cxx .hxx .inl .s .asm .rs .go .java .cs .js .jsx .ts .tsx .py .rb .swift .kt .scala .m .mm".split()
BUILD_NAMES = (
    "cmakelists.txt makefile gnumakefile kconfig .config build build.bazel workspace workspace.bazel meson.build sconstruct sconscript cargo.toml "
    "package.json pyproject.toml build.gradle build.gradle.kts"
).split()
BUILD_BEGINNINGS = "makefile. kconfig.".split()
BUILD_ENDINGS = "defconfig .cmake .mk .mak .bzl .gn .gni".split()
BUILD_PATH_WORDS = "build builds manifest manifests release releases changelog config configuration defconfig artifact artifacts linkmap".split()
BUILD_WORDS = "build release artifact binary linker".split()
BUILD_PHRASES = ("firmware image", "link map")
BUILD_KOREAN = "빌드 릴리스 산출물 배포본 배포판 배포이미지 바이너리 링커".split()
DISPOSITION_WORDS = (
    "include included includes exclude excluded excludes enable enabled enables disable disabled disables compile compiled compiles "
    "link linked links package packaged packages selected true false on off"
).split()
DISPOSITION_KOREAN = "포함 제외 활성 비활성 컴파일 링크 패키징".split()
SETTING_BEGINNING = "config_"
SETTING_ENDINGS = "_included _enabled _disabled _built _selected".split()
SETTING_VALUES = "y n m 0 1 true false on off".split()
SWITCHES = "set option".split()
SWITCH_VALUES = "0 1 true false on off".split()
TARGET_CALLS = "target_sources target_link_libraries add_executable add_library".split()
#: A name with the value it is set to, a call with its first two arguments.
SETTING = r"([a-z0-9_]+)[\"']?\s*[=:]\s*[\"']?([a-z0-9_]+)"
CALL = r"([a-z0-9_]+)\s*\(\s*([a-z0-9_]*)\s*([a-z0-9_]*)"


def _within(text: Column, phrases: list[str] | tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in phrases])


def _any_of(found: Column, values: list[str]) -> Column:
    return F.arrays_overlap(found, F.array(*map(F.lit, values)))


def is_build_document(path: Column, text: Column) -> Column:
    """Whether a document describes a build: by its name, unless it is source code; else by a word of its path, by a build
    setting or call in its text, or by words on builds together with words on what goes into them. Nothing minds case."""
    name, low = F.lower(basename(path)), F.lower(F.coalesce(text, F.lit("")))
    named = name.isin(BUILD_NAMES) | reduce(lambda a, b: a | b, [name.startswith(x) for x in BUILD_BEGINNINGS] + [name.endswith(x) for x in BUILD_ENDINGS])
    worded = _any_of(F.split(F.lower(path), r"[/\\_.-]"), BUILD_PATH_WORDS)
    words = F.regexp_extract_all(low, F.lit("([a-z0-9_]+)"), F.lit(1))
    spaced, close = F.regexp_replace(low, r"\s+", " "), F.regexp_replace(low, r"배포\s+", "배포")
    about = _any_of(words, BUILD_WORDS) | _within(spaced, BUILD_PHRASES) | _within(close, BUILD_KOREAN)
    disposed = _any_of(words, DISPOSITION_WORDS) | _within(low, DISPOSITION_KOREAN)
    part = lambda pattern, n: F.regexp_extract_all(low, F.lit(pattern), F.lit(n))
    settings = F.arrays_zip(part(SETTING, 1).alias("name"), part(SETTING, 2).alias("value"))
    calls = F.arrays_zip(part(CALL, 1).alias("name"), part(CALL, 2).alias("first"), part(CALL, 3).alias("second"))
    is_setting = lambda n: reduce(lambda a, b: a | b, [n.endswith(x) for x in SETTING_ENDINGS], n.startswith(SETTING_BEGINNING))
    is_set = F.exists(settings, lambda s: is_setting(s["name"]) & s["value"].isin(SETTING_VALUES))
    is_called = F.exists(
        calls,
        lambda c: c["name"].isin(TARGET_CALLS) | (c["name"].isin(SWITCHES) & (c["first"] != "") & c["second"].isin(SWITCH_VALUES)),
    )
    described = worded | is_set | is_called | (about & disposed)
    return F.coalesce(F.when(named, True).when(extension(path).isin(IMPLEMENTATION), False).otherwise(described), F.lit(False))


# What a folder scan takes and leaves.
SUPPORTED = (
    ".c .h .cpp .hpp .cc .cxx .hxx .py .js .jsx .ts .tsx .rs .go .java .cs .dts .dtsi .md .markdown .txt .rst .log .json .yaml .yml "
    ".toml .ini .cfg .conf .xml .html .htm .sh .ps1 .bat .cmake .pdf .docx"
).split()
EXCLUDED = ".git node_modules build dist .runtime .models vendor .venv venv".split()


def is_supported(path: Column) -> Column:
    """Supported by name, outside excluded directories, and no office lock file."""
    name = F.lower(basename(path))
    dirs = F.transform(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), F.lower)
    return (
        (name.isin("makefile", "cmakelists.txt") | extension(path).isin(*SUPPORTED))
        & ~F.arrays_overlap(dirs, F.array(*map(F.lit, EXCLUDED)))
        & ~basename(path).startswith("~$")
    )


def mention_place(text: Column, label: str) -> Column:
    """The 1-based place of a whole label in a text, without case, or 0; letters, digits, ``_``, ``.`` and ``-`` bound it."""
    edge = r"[A-Za-z0-9_.-]"
    return F.coalesce(F.regexp_instr(text, F.lit(rf"(?i)(?<!{edge}){re.escape(label)}(?!{edge})")), F.lit(0)) if label else F.lit(0)


def version_names(text: Column) -> Column:
    """Version names that a text spells out: a ``v``, numbers joined by dots, and what hangs on to them."""
    return F.regexp_extract_all(text, F.lit(r"(?i)(?<![A-Za-z0-9_.-])(v\d+(?:\.\d+)*(?:[-+][A-Za-z0-9.]+)?)(?![A-Za-z0-9_-])"), F.lit(1))

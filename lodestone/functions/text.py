"""Column functions on identifiers, paths and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rank weights and the noise penalty (fixed values).
CHURN_WEIGHT, CORENESS_WEIGHT, NOISE_PENALTY = 0.15, 0.06, 0.6
TEST_PATH = r"(?:^|/)(?:tests?/|test_)|_test\.|\.test\.|\.spec\.|_spec\."
NOISE_PATH = TEST_PATH + r"|(?:^|/)(?:generated|vendor|dist|node_modules|build|examples?|fixtures?|mocks?)/|\.generated\.|\.min\."
#: File extensions of each language (fixed values).
EXTENSIONS = {
    "python": ["py"], "rust": ["rs"], "go": ["go"], "javascript": ["js", "jsx", "mjs", "cjs"], "typescript": ["ts", "tsx"], "java": ["java"],
    "ruby": ["rb"], "php": ["php"], "kotlin": ["kt", "kts"], "swift": ["swift"], "csharp": ["cs"], "shell": ["sh", "bash"], "c": ["c"],
    "cpp": ["cc", "cpp", "cxx", "h", "hpp", "hxx"], "r": ["r", "R"], "scala": ["scala", "sc"], "dart": ["dart"], "lua": ["lua"], "elixir": ["ex", "exs"],
    "haskell": ["hs"], "ocaml": ["ml"], "zig": ["zig"], "powershell": ["ps1", "psm1", "psd1"], "groovy": ["groovy", "gvy", "gy", "gsh"], "markdown": ["md"], "sql": ["sql"],
}
LANGUAGES = {e: language for language, extensions in EXTENSIONS.items() for e in extensions}
#: A path in prose: extensions are fixed values.
PATH_REF = r"\.?[A-Za-z0-9_][A-Za-z0-9_/.-]*\.(?:rs|py|ts|tsx|js|jsx|go|rb|java|kt|swift|toml|json|ya?ml|sh|md)(?![A-Za-z0-9_])"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokenize_identifier(name: Column) -> Column:
    """Words of an identifier, lower-cased: at underscores, hyphens, and changes of case."""
    c = F.regexp_replace(name, r"[_\-]+", " ")
    c = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")
    return F.trim(F.lower(F.regexp_replace(c, "([A-Z]+)([A-Z][a-z])", "$1 $2")))


def is_test_path(path: Column) -> Column:
    """S16."""
    return F.rlike(lower_ascii(path), F.lit(TEST_PATH))


def is_noisy_path(path: Column) -> Column:
    return F.rlike(lower_ascii(path), F.lit(NOISE_PATH))


def rank_multiplier(path: Column, is_test: Column, churn: Column) -> Column:
    """S17."""
    return F.when(is_test | is_noisy_path(path), NOISE_PENALTY).otherwise(1 + CHURN_WEIGHT * F.coalesce(churn, F.lit(0.0)))


def coreness_boost(path: Column, is_test: Column, coreness: Column) -> Column:
    """S18."""
    return F.when(is_test | is_noisy_path(path), 1.0).otherwise(1 + CORENESS_WEIGHT * F.greatest(F.coalesce(coreness, F.lit(0)), F.lit(0)))


def language_of(path: Column) -> Column:
    """By the extension; null if unknown."""
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return names[F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)]


def symbol_document(*parts: Column) -> Column:
    """The parts that aren't empty, joined by a space."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def without_fences(text: Column) -> Column:
    """Text whose fenced code blocks are blank lines: fences open and close in turn."""
    step = lambda a, line: F.struct(
        F.when(F.ltrim(line).startswith("```"), ~a["open"]).otherwise(a["open"]).alias("open"),
        F.concat(a["lines"], F.array(F.when(F.ltrim(line).startswith("```") | a["open"], "").otherwise(line))).alias("lines"),
    )
    start = F.struct(F.lit(False).alias("open"), F.array().cast("array<string>").alias("lines"))
    folded = F.aggregate(F.split(text, "\n"), start, step, lambda a: F.array_join(a["lines"], "\n"))
    return F.when(F.contains(text, F.lit("```")), folded).otherwise(text)


def path_references(text: Column) -> Column:
    """Paths in prose, outside fenced code; not those with ``://`` in the 8 characters before, or ``~/`` right before."""
    found = F.regexp_extract_all(without_fences(text), F.lit(rf"(?:(?<=://[\s\S]{{0,5}})|(?<=~/)){PATH_REF}|({PATH_REF})"), 1)
    return F.transform(F.filter(found, lambda x: x != ""), lambda x: F.regexp_replace(x, r"^\./", ""))


def line_gutters(text: Column, first: int = 1) -> Column:
    """Each line with its number and a tab in front."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x, i: F.concat((i + first).cast("string"), F.lit("\t"), x)), "\n")


def range_checksum(text: Column, start: Column, end: Column) -> Column:
    """A hash of exactly these lines with their terminators; null out of range."""
    lines = F.split(text, "\n")
    ok = (start >= 1) & (end >= start) & (end <= F.size(lines))
    return F.when(ok, F.sha2(F.concat(F.array_join(F.slice(lines, F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0))), "\n"), F.when(end < F.size(lines), "\n").otherwise("")), 256))


def page(start: Column, end: Column, resume: Column, most: int) -> Column:
    """The page of a range: where it begins and ends, and what remains."""
    begin = F.greatest(start, F.least(F.coalesce(resume, start), end))
    stop = F.least(begin + most - 1, end)
    return F.struct(begin.alias("begin"), stop.alias("stop"), (end - stop).alias("remaining"), F.when(stop < end, stop + 1).alias("next"))


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression over the whole path."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else c if c in "[]" else "\\" + c if c in r".+(){}^$|\\" else c for c in glob) + "$"

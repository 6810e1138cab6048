"""Column functions on texts, names and paths.  All are null-safe: null in, null out, unless said otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.lexicon import ELISION, ILLEGAL, LIGATURES, NAME_SEPARATORS, READABLE

#: White space as Unicode has it; Spark's \s and trim know less.
S = r"(?U)\s"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """Compute value once a row and use it under a name."""
    return F.transform(F.array(value), then)[0]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"{S}+\z|\A{S}+", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"{S}+\z", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{S}+", "")


def collapse(c: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return strip(F.regexp_replace(c, rf"{S}+", " "))


def cut(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(c: Column) -> Column:
    """Unicode compatibility composition.  Spark has none, so Arrow batches go to Python, but for ASCII texts."""
    plain = c.rlike(r"\A\p{ASCII}*\z")
    return F.when(plain, c).otherwise(F.pandas_udf(composed, "string")(F.when(~plain, c)))


def normalize_ligatures(c: Column) -> Column:
    for joined, letters in LIGATURES.items():
        c = F.replace(c, F.lit(joined), F.lit(letters))
    return c


def normalize_pdf_text(c: Column, compose: bool = True) -> Column:
    """Join broken words and lines, collapse blanks.  compose: with NFKC first."""
    c = normalize_ligatures(nfkc(c) if compose else c)
    c = F.regexp_replace(c, rf"([A-Za-z])-+{S}*\n(?U)\s*([A-Za-z])", "$1$2")
    c = F.regexp_replace(c, rf"{S}*\n(?U)\s*", " ")
    return strip(F.regexp_replace(c, r"[ \t]+", " "))


def truncate_text(c: Column, n: int) -> Column:
    """Cut at n characters, back to the last space if that lies beyond 0.8 n."""
    head = cut(c, n)
    last = F.length(head) - F.locate(" ", F.reverse(head))
    at_space = F.contains(head, F.lit(" ")) & (last > n * 0.8)
    return F.when(F.length(c) <= n, c).otherwise(rstrip(F.when(at_space, F.substring(head, F.lit(1), last)).otherwise(head)))


def select_analysis_text(c: Column, n: int) -> Column:
    """Head, middle and tail of a long text, in n characters together with the marks between them."""
    size = len(ELISION)
    if n <= size * 2 + 3:
        return cut(c, n)
    budget = n - size * 2
    head, middle = budget // 2, budget // 4
    tail = budget - head - middle
    start = F.greatest(F.lit(0), F.floor(F.length(c) / 2).cast("int") - middle // 2)
    parts = F.concat(rstrip(cut(c, head)), F.lit(ELISION), strip(F.substring(c, start + 1, F.lit(middle))), F.lit(ELISION), lstrip(F.substring(c, F.length(c) - tail + 1, F.lit(tail))))
    return F.when(F.length(c) <= n, c).otherwise(parts)


def readable_ratio(c: Column) -> Column:
    """Share of Hangul syllables, ASCII and common marks; 0 for the empty text."""
    kept = F.length(F.regexp_replace(c, rf"[^가-힣\x00-\x7F{READABLE}]", ""))
    return F.when(F.length(c) == 0, F.lit(0.0)).otherwise(kept / F.length(c))


def is_garbled(c: Column, least: float = 0.5) -> Column:
    return (F.length(strip(c)) > 0) & (readable_ratio(c) < least)


def clean_control(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, "\r\x0b", "\n\n"), r"[\x00-\x08\x0c\x0e-\x1f]+", " ")


def salvage_tokens(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(c, F.lit(r"[가-힣]{2,}|[A-Za-z]{2,}|[0-9][0-9.,\-:~년월일종호]*"), F.lit(0)), " ")


def printable_runs(c: Column, least: int = 8) -> Column:
    runs = F.regexp_extract_all(c, F.lit(r"[가-힣A-Za-z0-9][가-힣A-Za-z0-9 .,()\-_:%/·]{" + str(least - 1) + ",}"), F.lit(0))
    return F.array_join(F.transform(runs, strip), " ")


def normalize_text(c: Column, n: int = 2000) -> Column:
    c = F.regexp_replace(F.translate(c, "\x00", " "), r"[ \t]+", " ")
    return cut(strip(F.regexp_replace(c, r"\n{3,}", "\n\n")), n)


def safe_filename(c: Column, n: int | None = 90) -> Column:
    """Illegal characters and white space to "_"; n: cut before the ends are cleaned; never empty."""
    c = F.regexp_replace(strip(F.regexp_replace(c, ILLEGAL, "_")), rf"{S}+", "_")
    c = F.regexp_replace(cut(c, n) if n else c, r"\A[._]+|[._]+\z", "")
    return F.when(c == "", "untitled").otherwise(c)


def sanitize(c: Column) -> Column:
    return safe_filename(c, None)


def _separators() -> str:
    return "[" + "".join("\\" + x if x in "-.()[]{}" else x for x in NAME_SEPARATORS) + "]"


SEPARATORS = _separators()


def squash(c: Column) -> Column:
    """Lower case without separators and white space."""
    return F.lower(F.regexp_replace(c, rf"{SEPARATORS}|{S}", ""))


def clean_component(c: Column) -> Column:
    """One safe part of a file name; null counts as empty."""
    c = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r'[\\/:*?"<>|\x00-\x1f]', " "), rf"{S}+", " ")
    return F.replace(F.regexp_replace(c, r"\A[ ._]+|[ ._]+\z", ""), F.lit(" "), F.lit("_"))


def flat_evidence(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^0-9A-Za-z가-힣]", ""))


def document_semester(c: Column) -> Column:
    pattern = rf"(20\d{{2}}){S}*(?:[-./년]{S}*)?([12]){S}*(?:학기)?"
    year = F.regexp_extract(c, pattern, 1)
    return F.when(year == "", "").otherwise(F.concat_ws("-", year, F.regexp_extract(c, pattern, 2)))


def slashes(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, "\\", "/"), "/+$", "")


def is_under(path: Column, root: Column) -> Column:
    path, root = slashes(path), slashes(root)
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def path_parts(c: Column) -> Column:
    return F.filter(F.split(c, r"[\\/]"), lambda x: x != "")


def parent_folder(c: Column) -> Column:
    """All parts but the last; a path of one part is its own parent."""
    parts = path_parts(c)
    return F.when(F.size(parts) <= 1, c).otherwise(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), "/"))


def relative_folder(root: Column, folder: Column) -> Column:
    """folder below root; "." for root itself and for what lies outside."""
    root, folder = F.array_join(path_parts(root), "/"), F.array_join(path_parts(folder), "/")
    return F.when(F.startswith(folder, F.concat(root, F.lit("/"))), F.substring(folder, F.length(root) + 2, F.length(folder))).otherwise(".")


def stem(name: Column) -> Column:
    """A file name without its last extension; a leading dot starts no extension."""
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)


def suffix(name: Column) -> Column:
    """The last extension with its dot, else empty."""
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"(\.[^.]+)$", 1)).otherwise("")


def filename_tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(name, r"(?i)\.(pdf|txt|md)$", ""), rf"(?U)[_\s\-()]+"), lambda x: x != ""))


def short_reason(c: Column, n: int = 180) -> Column:
    return cut(collapse(c), n)


def confidence_percent(x: Column) -> Column:
    """0 to 1 times 100, larger values as they are; null as "0%"."""
    value = F.when(x > 1, x).otherwise(x * 100)
    return F.coalesce(F.concat(F.floor(value + 0.5).cast("string"), F.lit("%")), F.lit("0%"))


def index_text(path: Column, text: Column, n: int = 800) -> Column:
    """Words of the name, the folder, and the text: what a document is found by."""
    name = F.element_at(F.split(path, "/"), -1)
    parts = F.split(path, "/")
    folder = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    return cut(F.concat_ws("\n", F.translate(stem(name), "_-", "  "), folder, text), n)

"""Text rules over whole tables: normalisation, quality, redaction, sanitising, snippets, labels, leaks (B)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactloom.functions.dictionary import FINDING, replace_names
from pactloom.functions.rules import REDACTION_RULES, SANITIZE_RULES


def replace_in_order(col: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Rules one after the other: their order is part of the result."""
    for pattern, replacement in rules:
        col = F.regexp_replace(col, pattern, replacement)
    return col


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def normalize_ws(col: Column, mode: str = "collapse") -> Column:
    """B1. collapse: all white space to one blank; lines: blanks within lines, three and more line ends to two;
    flat: line ends and no-break spaces to blanks; dashes: soft hyphens off, dashes and no-break spaces unified."""
    if mode == "collapse":
        return strip(F.regexp_replace(col, r"(?U)\s+", " "))
    if mode == "lines":
        return strip(replace_in_order(col, [("\r\n?", "\n"), (r"[ \t\x0B\f ]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n")]))
    if mode == "flat":
        return F.translate(col, "\n ", "  ")
    if mode == "dashes":
        return F.translate(col, "‐‑‒–— ­", "----- ")
    raise ValueError(mode)


def fold_text(col: Column) -> Column:
    """B2: lower case, ä and å to a, ö to o."""
    return F.translate(F.lower(col), "äöå", "aoa")


def hundredths(x: Column) -> Column:
    """Two decimals of a double by its own value, as SQL rounds doubles. Spark rounds the digits that a double is shown with, which takes 1.005, a little less than that, up."""
    return F.round(x * 100, 0) / 100


def printable_share(col: Column) -> Column:
    """B3 A: 100 * printable characters / characters of the stripped text, 2 decimals; 0 for an empty one."""
    t = strip(F.coalesce(col, F.lit("")))
    return F.when(F.length(t) == 0, F.lit(0.0)).otherwise(hundredths(100.0 * F.length(F.regexp_replace(t, r"[\p{C}\p{Zl}\p{Zp}\p{Zs}&&[^ ]]", "")) / F.length(t)))


def letter_share(col: Column) -> Column:
    """B3 B: 100 * letters / characters, 2 decimals; 0 for an empty text."""
    t = F.coalesce(col, F.lit(""))
    return F.when(F.length(t) == 0, F.lit(0.0)).otherwise(hundredths(100.0 * F.length(F.regexp_replace(t, r"[^\p{L}]", "")) / F.length(t)))


def content_hash(col: Column) -> Column:
    """sha256; null as the empty text."""
    return F.sha2(F.coalesce(col, F.lit("")), 256)


def finding(kind: str, placeholder: str) -> Callable[[Column], Column]:
    return lambda v: F.struct(F.lit(kind).alias("pii_type"), F.lit(placeholder).alias("placeholder"), F.sha2(v, 256).alias("value_hash"))


def redact(df: DataFrame, text_col: str, names: Iterable[tuple[str, str, str]] = (), dict_df: DataFrame | None = None) -> DataFrame:
    """Text with personal data replaced, and findings array<struct<pii_type, placeholder, value_hash>>: one for each distinct
    value, in the order of the rules; the hash is the value's, which is never shown.

    dict_df (name, replacement, pii_type, order) is a dictionary of literal names of any length (`dictionary.replace_names`), names are ordered (pattern, replacement, type)
    of a caller; both come before the general rules, and case doesn't count.
    """
    rules = [(kind, f"(?iu){p}", r) for p, r, kind in names] + [(kind, p, r) for kind, p, r in REDACTION_RULES]
    if dict_df is not None:
        df = replace_names(df, text_col, dict_df)
    text, found = F.col(text_col), [F.coalesce("name_findings", F.array().cast(FINDING))] if dict_df is not None else []
    for kind, pattern, placeholder in rules:
        values = F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        found.append(F.transform(F.coalesce(values, F.array().cast("array<string>")), finding(kind, placeholder)))
        text = F.regexp_replace(text, pattern, placeholder.replace("$", r"\$"))
    return df.withColumn("findings", F.array_distinct(F.concat(*found))).withColumn(text_col, text).drop("name_findings")


def sanitize(col: Column) -> Column:
    """The ordered rules of public output."""
    return replace_in_order(col, SANITIZE_RULES)


def clean_answer_text(col: Column) -> Column:
    """B6, then amounts, Windows paths and white space."""
    more = [(r"(?U)\b\d[\d\s]*(?:,\d{2})?\s*(?:€|eur(?:oa)?\b)", "[amount redacted]"), (r"[A-Za-z]:\\[^\s]+", "[path redacted]")]
    return normalize_ws(replace_in_order(sanitize(col), more))


def cut(col: Column, n: int) -> Column:
    """At most n characters, an ellipsis for the rest."""
    return F.when(F.length(col) > n, F.concat(F.regexp_replace(F.substring(col, 1, n - 1), r"(?U)\s+$", ""), F.lit("…"))).otherwise(col)


def snippet(col: Column, n: int = 600) -> Column:
    """Sanitised, white space collapsed, cut."""
    return cut(normalize_ws(sanitize(F.coalesce(col, F.lit("")))), n)


def anonymize_labels(df: DataFrame, packet: str, key: str, position: str, label: str = "reference_label") -> DataFrame:
    """reference_001, ... by first position of the key in its packet."""
    first = df.groupBy(packet, key).agg(F.min(position).alias("__first"))
    rank = F.dense_rank().over(Window.partitionBy(packet).orderBy("__first", key))
    return df.join(first.withColumn(label, F.format_string("reference_%03d", rank)).drop("__first"), [packet, key])


def leak_scan(df: DataFrame, text_col: str, patterns: dict[str, str]) -> DataFrame:
    """Names of the patterns that a text still shows."""
    hits = F.filter(F.array(*[F.when(F.regexp_like(F.col(text_col), F.lit(p)), F.lit(n)) for n, p in patterns.items()]), lambda x: x.isNotNull())
    return df.withColumn("leaks", hits)


LEAK_PATTERNS = {"windows_path": r"[A-Za-z]:\\", "file_name": r"(?i)\.(pdf|docx?|xlsx?|dwg)([^a-z0-9]|$)", "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "company": r"[A-Z][a-z]+ (Oy|Ab|Ky)([^a-z]|$)"}

"""Line dedup with a log-template tree, in DataFrame functions only.

The tree has a fixed depth: token count, then the leading tokens, then up to four splits at the position of the fewest
tokens. Tokens with a digit are variable fields. Where no single token prevails at a position, it is a variable field as
well, which gives a group's generalised template.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactloom.llm.staging import stage

BLANK = " \\t\\x0B\\f\\r"
VARIABLE = "<*>"


def normal_line(line: Column) -> Column:
    """A line's words, one blank apart; words with a digit become <*>. The costly rules only run on lines that need them."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, f"(?<![^{BLANK}])[^{BLANK}0-9]*[0-9][^{BLANK}]*", VARIABLE)).otherwise(line)
    odd = F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for c in "\t\x0b\f\r":
        odd = odd | F.contains(line, F.lit(c))
    return F.when(odd, F.trim(F.regexp_replace(masked, f"[{BLANK}]+", " "))).otherwise(masked)


def word_count(normal: Column) -> Column:
    return F.when(normal == "", 0).otherwise(F.length(normal) - F.length(F.replace(normal, F.lit(" "))) + 1)


def line_key(normal: Column) -> Column:
    return F.xxhash64(normal)


def leaf_filter(leaves: DataFrame, bits: int = 1 << 21) -> DataFrame:
    """One row of fixed size: a bit for each hash of the leaves, as bits / 64 numbers."""
    at = F.pmod(F.col("leaf"), F.lit(bits))
    words = leaves.select(F.floor(at / 64).alias("i"), F.expr(f"shiftleft(1L, cast(pmod(leaf, {bits}) % 64 as int))").alias("b")).groupBy("i").agg(F.bit_or("b").alias("b"))
    every = leaves.sparkSession.range(bits // 64).withColumnRenamed("id", "i").join(words, "i", "left").select("i", F.coalesce("b", F.lit(0)).alias("b"))
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "b"))), lambda x: x["b"]).alias("known"))


def weight(text: Column) -> Column:
    """Characters other than blanks, tabs and line ends."""
    return F.length(F.replace(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\t"), F.lit("")), F.lit("\n"), F.lit("")))


def has_word(normal: Column) -> Column:
    """Whether a line has a word that is no variable field."""
    return F.replace(F.replace(normal, F.lit(VARIABLE), F.lit("")), F.lit(" "), F.lit("")) != ""


def templates(members: DataFrame, depth: int, prevailing: float, min_constant: float) -> DataFrame:
    """(line_key, template): the generalised templates of leaves, members (leaf, line_key, w: words).

    In a group of lines, a position is constant where one token has a share of `prevailing` or more. Groups whose constant
    positions make up min_constant are a template; the lines that don't fit it go on as a group of their own. Other groups are split
    at the position with the fewest tokens that is not constant, up to `depth` levels below the leaf.
    """
    found = []
    group = members.select(F.col("leaf").alias("part"), "line_key", "w")
    for _ in range(depth):
        group = stage(group.join(group.groupBy("part").agg(F.count("*").alias("total")).where("total > 1"), "part"), "groups")
        if group.isEmpty():
            break
        at = group.select("part", "total", F.posexplode("w").alias("pos", "word")).groupBy("part", "pos", "word").agg(F.count("*").alias("n"), F.first("total").alias("total"))
        best = at.groupBy("part", "pos").agg(F.max(F.struct("n", "word")).alias("b"), F.count("*").alias("kinds"), F.first("total").alias("total"))
        is_constant = F.col("b.n") >= prevailing * F.col("total")
        rule = best.groupBy("part").agg(F.collect_list(F.when(is_constant, F.struct("pos", F.col("b.word").alias("word")))).alias("constant"), F.min(F.when(~is_constant, F.struct("kinds", "pos"))).alias("split"), F.count("*").alias("size"))
        judged = group.join(rule, "part").withColumn("good", F.size("constant") >= min_constant * F.col("size"))
        judged = stage(judged.withColumn("fits", F.col("good") & F.forall("constant", lambda c: F.get("w", c["pos"]) == c["word"])).drop("total", "constant", "size"), "judged")
        found.append(judged.where("fits").select("line_key", F.col("part").alias("template")))
        onward = F.when(F.col("good"), F.xxhash64("part", F.lit("rest"))).otherwise(F.xxhash64("part", "split.pos", F.get("w", F.col("split.pos"))))
        group = judged.where("NOT fits").select(onward.alias("part"), "line_key", "w")
    empty = members.where("false").select("line_key", F.col("leaf").alias("template"))
    return reduce(DataFrame.unionByName, found, empty)


def recurring_lines(texts: DataFrame, min_docs: int, lead: int, min_tokens: int, prevailing: float, min_constant: float, own: float, depth: int, bits: int = 1 << 21) -> DataFrame:
    """(th, line_key): the lines of each text that belong to a recurring template."""
    lines = texts.select("th", "text", weight(F.col("text")).alias("size"))  # below the generator: once a text
    lines = lines.select("th", "size", F.explode(F.transform(F.split("text", "\n"), lambda x: F.struct(normal_line(x).alias("w"), weight(x).alias("chars")))).alias("x"))  # and a line's rules once
    lines = lines.select("th", "size", "x.chars", "x.w").where(has_word(F.col("w"))).withColumn("words", word_count(F.col("w")))
    keyed = lines.select("th", "size", "w", "chars", line_key(F.col("w")).alias("line_key"), F.when(F.col("words") >= min_tokens, F.xxhash64("words", F.substring_index("w", " ", lead))).alias("leaf"))
    index = stage(keyed.groupBy("th", "line_key", "leaf").agg(F.sum("chars").alias("chars"), F.max("size").alias("size")), "lines")

    exact = index.groupBy("line_key").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("line_key", "n", F.lit(None).cast("bigint").alias("template"))

    varied = index.where("leaf IS NOT NULL").groupBy("leaf", "th").agg(F.min("line_key").alias("a"), F.max("line_key").alias("b"))
    varied = stage(varied.groupBy("leaf").agg(F.count("*").alias("n"), F.min("a").alias("a"), F.max("b").alias("b")).where((F.col("n") >= min_docs) & (F.col("a") != F.col("b"))).select("leaf"), "varied")
    likely = keyed.where("leaf IS NOT NULL").crossJoin(F.broadcast(leaf_filter(varied, bits))).where(F.expr(f"shiftrightunsigned(get(known, cast(floor(pmod(leaf, {bits}) / 64) as int)), cast(pmod(leaf, {bits}) % 64 as int)) & 1 = 1"))  # one row of bits / 8 bytes
    members = stage(likely.join(varied, "leaf", "left_semi").groupBy("leaf", "line_key").agg(F.split(F.first("w"), " ").alias("w")), "leaves")
    general = templates(members, depth, prevailing, min_constant).select("line_key", F.lit(None).cast("bigint").alias("n"), "template")

    candidates = exact.unionByName(general).groupBy("line_key").agg(F.max("n").alias("exact"), F.max("template").alias("template"))
    met = stage(index.drop("leaf").join(candidates, "line_key"), "met")
    spread = met.where("template IS NOT NULL").select("template", "th").distinct().groupBy("template").agg(F.count("*").alias("general")).where(F.col("general") >= min_docs)
    hits = met.join(spread, "template", "left").withColumn("n", F.greatest("exact", "general")).where("n IS NOT NULL")  # the larger of those there are
    hits = stage(hits, "hits")
    left = hits.groupBy("th").agg(F.sum("chars").alias("shared"), F.max("size").alias("size")).where((F.col("size") - F.col("shared")) < own * F.col("size"))
    upto = hits.join(left.select("th", (F.col("size") - F.col("shared")).alias("alone")), "th").withColumn("upto", F.col("alone") + F.sum("chars").over(Window.partitionBy("th").orderBy("n")))
    crowd = stage(upto.where(F.col("upto") >= own * F.col("size")).groupBy("th").agg(F.min("n").alias("crowd")), "crowds")
    seen = stage(hits.join(crowd, "th", "left").select("th", "line_key", "template", "exact", "general", F.coalesce("crowd", F.lit(1)).alias("crowd")), "seen")
    line = seen.where(F.col("exact") >= min_docs * F.col("crowd")).groupBy("line_key").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("line_key")
    kind = seen.where(F.col("general") >= min_docs * F.col("crowd")).select("template", "th").distinct().groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("template")
    by_line = seen.where("exact IS NOT NULL").join(line, "line_key", "left_semi").select("th", "line_key")
    by_kind = seen.where("general IS NOT NULL").join(kind, "template", "left_semi").select("th", "line_key")
    return by_line.unionByName(by_kind)


def drop_recurring_lines(
    docs: DataFrame, text_col: str = "text", min_docs: int = 5, lead: int = 3, min_tokens: int = 3, prevailing: float = 0.9, min_constant: float = 0.6, own: float = 1 / 9, depth: int = 4
) -> DataFrame:
    """All rows and columns of docs; text without the lines of recurring templates, and dropped_lines int.

    Templates are exact masked lines, of any number of words but with one that is no variable field, and the generalised lines of
    leaves (token count and leading tokens, min_tokens or more), which are split further where one template doesn't cover them. A template recurs if
    min_docs different texts vouch for it. A text's crowd is the least number of texts such that its lines that stand in no
    more than so many hold a share `own` of its characters; lines in fewer than min_docs texts count as in one. It vouches for templates that stand in
    min_docs times its crowd or more: so a page with a little of its own vouches for all its boilerplate, and near-copies of one
    document (with 1/9 of their own at most, a similarity of 0.8) don't vouch for each other's lines; those are left to document dedup. A recurring
    template goes from every text, whatever share of it that takes; a text with many exact copies counts once.

    Defined results: null and empty texts stay as they are; a text of recurring lines alone becomes empty; lines without a word, or of words
    with digits only, stay; repeated rows are treated alike; very long texts and lines are read whole; no rows give no
    rows; all other columns of docs are kept under any names, but for one named dropped_lines.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "dropped_lines"]).alias("row"))
    text = F.col(f"row.`{text_col}`").cast("string")
    rows = rows.withColumn("th", F.unhex(F.sha1(text)))  # the text itself is shuffled once, in its row
    found = recurring_lines(rows.where(text.isNotNull()).select("th", text.alias("text")), min_docs, lead, min_tokens, prevailing, min_constant, own, depth)
    marked = stage(found.groupBy("th").agg(F.collect_set("line_key").alias("gone")), "marked")  # as a table, so that the join below may split a hot text
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("gone", line_key(normal_line(x))))
    cleaned = rows.join(marked, "th", "left").withColumn("kept", F.when(F.col("gone").isNotNull(), kept))
    lost = F.when(F.col("kept").isNotNull(), F.size(F.split(text, "\n")) - F.size("kept")).otherwise(0)
    column = lambda c: F.when(F.col("kept").isNotNull(), F.array_join("kept", "\n")).otherwise(text).alias(c) if c == text_col else F.col(f"row.`{c}`")
    return cleaned.select(*[column(c) for c in docs.columns if c != "dropped_lines"], lost.alias("dropped_lines"))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, text (cleaned), dropped_lines of every document."""
    return drop_recurring_lines(docs.select("doc_id", "text"))


def dedup_sql(min_docs: int = 5, depth: int = 4) -> str:
    rounds = []
    for k in range(depth):
        rounds.append(f"""g{k} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY part) AS total FROM p{k} QUALIFY total > 1),
b{k} AS MATERIALIZED (SELECT part, pos, arg_max(word, c) AS word, max(c) >= 0.9 * max(total) AS constant, count(*) AS kinds FROM
(SELECT part, pos, word, count(*) AS c, max(total) AS total FROM (SELECT part, total, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM g{k}) GROUP BY ALL) GROUP BY part, pos),
r{k} AS MATERIALIZED (SELECT part, count(*) FILTER (constant) >= 0.6 * count(*) AS good, list({{'pos': pos, 'word': word}}) FILTER (constant) AS constants, arg_min(pos, (kinds, pos)) FILTER (NOT constant) AS split FROM b{k} GROUP BY part),
j{k} AS MATERIALIZED (SELECT g{k}.part, line_key, w, good, split, good AND len(list_filter(constants, lambda x: w[x.pos + 1] <> x.word)) = 0 AS fits FROM g{k} JOIN r{k} USING (part)),
p{k + 1} AS MATERIALIZED (SELECT CASE WHEN good THEN part || '/rest' ELSE part || '/' || split || '=' || w[split + 1] END AS part, line_key, w FROM j{k} WHERE NOT fits)""")
    fits = " UNION ALL ".join(f"SELECT line_key, part AS template FROM j{k} WHERE fits" for k in range(depth))
    return f"""
WITH d AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
l AS (SELECT text, unnest(string_split(text, chr(10))) AS line FROM d),
w AS (SELECT text, line, list_filter(regexp_split_to_array(regexp_replace(line, '[^{BLANK}0-9]*[0-9][^{BLANK}]*', '{VARIABLE}', 'g'), '[{BLANK}]+'), lambda t: t <> '') AS w FROM l),
every AS MATERIALIZED (SELECT text, line, w, array_to_string(w, ' ') AS line_key, length(translate(line, ' ' || chr(9), '')) AS chars, CASE WHEN len(w) >= 3 THEN len(w) || ' ' || array_to_string(w[1:3], ' ') END AS leaf FROM w
WHERE translate(replace(array_to_string(w, ' '), '{VARIABLE}', ''), ' ', '') <> ''),
k AS MATERIALIZED (SELECT text, line_key, leaf, any_value(w) AS w, sum(chars) AS chars FROM every GROUP BY text, line_key, leaf),
exact AS (SELECT line_key, count(*) AS n FROM k GROUP BY line_key HAVING count(*) >= {min_docs}),
varied AS (SELECT leaf FROM k WHERE leaf IS NOT NULL GROUP BY leaf HAVING count(DISTINCT text) >= {min_docs} AND count(DISTINCT line_key) > 1),
p0 AS MATERIALIZED (SELECT leaf AS part, line_key, any_value(w) AS w FROM k JOIN varied USING (leaf) GROUP BY leaf, line_key),
{", ".join(rounds)},
fits AS MATERIALIZED ({fits}),
spread AS (SELECT template, count(DISTINCT text) AS general FROM k JOIN fits USING (line_key) GROUP BY template HAVING count(DISTINCT text) >= {min_docs}),
hits AS MATERIALIZED (SELECT text, line_key, template, exact.n AS exact, general, greatest(exact.n, general) AS n, chars FROM k LEFT JOIN exact USING (line_key) LEFT JOIN fits USING (line_key) LEFT JOIN spread USING (template) WHERE exact.n IS NOT NULL OR general IS NOT NULL),
size AS (SELECT text, length(translate(text, ' ' || chr(9) || chr(10), '')) AS size, sum(chars) AS shared FROM hits GROUP BY text),
upto AS (SELECT text, n, size, size - shared + sum(chars) OVER (PARTITION BY text ORDER BY n) AS upto FROM hits JOIN size USING (text) WHERE size - shared < {1 / 9} * size),
crowd AS (SELECT text, min(n) AS crowd FROM upto WHERE upto >= {1 / 9} * size GROUP BY text),
seen AS MATERIALIZED (SELECT hits.*, coalesce(crowd, 1) AS crowd FROM hits LEFT JOIN crowd USING (text)),
line AS (SELECT line_key FROM seen WHERE exact >= {min_docs} * crowd GROUP BY line_key HAVING count(*) >= {min_docs}),
kind AS (SELECT template FROM seen WHERE general >= {min_docs} * crowd GROUP BY template HAVING count(DISTINCT text) >= {min_docs}),
bad AS (SELECT line_key FROM line UNION SELECT line_key FROM fits JOIN kind USING (template)),
gone AS (SELECT text, list(DISTINCT line) AS gone FROM every JOIN bad USING (line_key) GROUP BY text),
new AS (SELECT doc_id, documents.text, string_split(documents.text, chr(10)) AS lines, list_filter(string_split(documents.text, chr(10)), lambda x: NOT coalesce(list_contains(gone, x), false)) AS kept FROM documents LEFT JOIN gone ON documents.text = gone.text)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text, CASE WHEN text IS NULL THEN 0 ELSE len(lines) - len(kept) END AS dropped_lines FROM new"""

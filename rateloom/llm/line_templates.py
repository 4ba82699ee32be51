"""Line dedup by a log-template tree: templates that recur across documents are dropped, as DataFrame expressions only.

Tree. A line is parsed at fixed depth: the number of its tokens (split at blanks), then its first `DEPTH` tokens. Tokens
with a digit are variable fields from the start and read `<*>`. A line that recurs as it stands (digits aside) is a
template without variable fields, and takes no further part.

The other lines of a leaf generalise by how often their tokens stand at their places. A token has level j if it stands at
its place in `MIN_DOCS` * 2^j or more of the leaf's texts (its highest such j). At level j a line's template is its
tokens of level j or more, the rest `<*>`; it needs at least `CONSTANT` of its tokens constant. So a line has a template
for each level that its tokens have, from the most special to the most general: of many templates that share a leaf each
is seen at the level of its own texts, however busy the leaf is, and a field value that recurs by chance doesn't hide the
template with the field.

A template found in `MIN_DOCS` different texts or more is dropped: all its lines go from all documents. Texts are
counted, not rows, so exact copies of a document don't make its lines boilerplate. A variant in fewer than `MIN_DOCS` texts stays if the
place where it differs is constant, at the template's own level, in the others. Lines of fewer than `MIN_TOKENS`
tokens are never dropped, nor is a line of blanks.

Lines, leaves and texts are known by 64-bit hashes. Counting distinct texts takes two partial aggregations, so a line
that a third of all texts holds is summed on the map side and no task sees its rows together. Tokens meet their levels
in a broadcast where there are few (`BROADCAST_ROWS`), else in a join whose small side is repeated `SALT` times, so that a
token of a third of all lines is many tasks. A line of any length costs in proportion to its tokens.

Defined results: null and empty texts have no lines and stay as they are; repeated rows are cleaned alike; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rateloom.session import materialize, table

DEPTH = 3
MIN_DOCS = 8
MIN_TOKENS = 4
CONSTANT = 0.7
VARIABLE = "<*>"
#: A token with a digit, tried at token starts only.
NUMBERED = r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+"
#: The driver builds what is broadcast: 446,000 levels took it to 995 MB, joined by shuffle 774 MB (750 MB heap).
BROADCAST_ROWS = 131_072
SALT = 32


def masked(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit("[0-9]")), F.regexp_replace(text, NUMBERED, VARIABLE)).otherwise(text)


def token_count(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def exploded(documents: DataFrame, text: str) -> DataFrame:
    """A row per line that can be dropped: doc, at, line (masked), n, key of the line and of its leaf."""
    rows = documents.select(F.col(text).alias("text")).where("text is not null")
    lines = rows.select(text_key(F.col("text")).alias("doc"), F.posexplode(F.split(masked(F.col("text")), "\n")).alias("at", "line"))
    lines = lines.withColumn("n", token_count(F.col("line"))).where((F.col("n") >= MIN_TOKENS) & (F.trim("line") != ""))
    leaf = F.xxhash64(F.lit("leaf"), "n", F.substring_index("line", " ", DEPTH))
    return lines.select("doc", "at", "line", "n", F.xxhash64("line").alias("key"), leaf.alias("leaf"))


def recurring(rows: DataFrame, keys: list[str], min_docs: int) -> DataFrame:
    """Keys that stand in at least min_docs different texts, with that number."""
    return rows.groupBy(*keys).agg(F.count_distinct("doc").alias("docs")).where(F.col("docs") >= min_docs)


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint behind a count; a larger table is joined by shuffle, whatever size the planner takes it for."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def templates(documents: DataFrame, *, text: str = "text", min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(doc, at) of the lines to drop, and the templates themselves with the number of their texts."""
    base = exploded(documents, text)
    compact = materialize(base.select("doc", "at", "key", "leaf"), "lines")
    both = compact.select("doc", F.explode(F.array("key", "leaf")).alias("key"))
    often = materialize(recurring(both, ["key"], min_docs), "often")
    whole = compact.join(small(often.select("key")), "key", "left_semi").select("doc", "at")
    # variable fields: only leaves that recur can hold a recurring template
    leaves = often.select(F.col("key").alias("leaf"))
    inside = base.join(small(leaves), "leaf", "left_semi").join(small(often.select("key")), "key", "left_anti")
    inside = materialize(inside.select("doc", "at", "line", "n", "leaf").distinct(), "inside")  # of repeated rows one
    tokens = inside.select("doc", "at", "leaf", "n", F.posexplode(F.split("line", " ")).alias("place", "token"))
    tokens = tokens.where(F.col("token") != VARIABLE).select("doc", "at", "n", F.xxhash64("leaf", "place", "token").alias("spot"), "place")
    counts = recurring(tokens, ["spot"], min_docs)
    levels = materialize(counts.select("spot", F.floor(F.log2(F.col("docs") / min_docs) + 1e-9).cast("int").alias("level")), "levels")
    leveled = with_level(tokens, levels).groupBy("doc", "at", "n").agg(F.array_sort(F.collect_list(F.struct("place", "spot", "level"))).alias("fixed"))
    leveled = leveled.where(F.size("fixed") >= F.col("n") * CONSTANT)
    each = leveled.select("doc", "at", "n", "fixed", F.explode(F.array_distinct(F.col("fixed.level"))).alias("least"))
    each = each.withColumn("fixed", F.filter("fixed", lambda t: t["level"] >= F.col("least"))).where(F.size("fixed") >= F.col("n") * CONSTANT)
    shaped = materialize(each.select("doc", "at", F.xxhash64(F.col("fixed.spot"), "n").alias("key"), F.col("fixed.place").alias("places")), "shaped")
    again = materialize(recurring(shaped, ["key"], min_docs), "templates")
    general = shaped.join(small(again), "key", "left_semi").select("doc", "at")
    example = shaped.join(small(again), "key").groupBy("key").agg(F.min(F.struct("doc", "at", "places")).alias("one"), F.max("docs").alias("docs"))
    lines = example.select("one.*", "docs").join(inside, ["doc", "at"]).withColumn("line", F.split("line", " "))
    wording = F.transform("line", lambda t, i: F.when(F.array_contains("places", i), t).otherwise(F.lit(VARIABLE)))
    return whole.union(general), lines.select(F.array_join(wording, " ").alias("template"), "docs").distinct()


def with_level(tokens: DataFrame, levels: DataFrame) -> DataFrame:
    """The tokens that have a level, with it."""
    if levels.count() <= BROADCAST_ROWS:
        return tokens.join(F.broadcast(levels), "spot")
    # the planner's size of this leaves out the SALT copies, so by size alone it would broadcast them
    salted = levels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).hint("merge")
    return tokens.withColumn("salt", F.pmod(F.xxhash64("doc", "at"), F.lit(SALT)).cast("int")).join(salted, ["spot", "salt"]).drop("salt")


def cleaned(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """A row per document: doc_id, n_lines (lines with a token), n_dropped, text without the dropped lines."""
    drops, _ = templates(documents, text=text, min_docs=min_docs)
    drops = materialize(drops.distinct().groupBy("doc").agg(F.collect_list("at").alias("dropped")), "drops")
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), text_key(F.col(text)).alias("doc"))
    joined = rows.join(drops.hint("shuffle_hash"), "doc", "left")
    lines = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped"))
    left = F.array_join(F.transform(stay, lambda k: F.get(lines, k)), "\n")
    return joined.select(
        "doc_id", F.coalesce(F.size(F.filter(lines, lambda x: F.trim(x) != "")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(left).alias("text"),
    )


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(table(spark, sf_dir, "documents"))


OP10_SQL = f"""
WITH texts AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
lines AS (SELECT text, unnest(range(len(l))) AS spot, unnest(l) AS raw FROM (SELECT text, string_split(text, chr(10)) AS l FROM texts)),
tok AS (SELECT text, spot, list_transform(string_split(raw, ' '), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '{VARIABLE}' ELSE t END) AS w FROM lines),
uses AS (SELECT text, spot, w, len(w) AS n, array_to_string(w, ' ') AS line, len(w) || ' ' || array_to_string(w[1:{DEPTH}], ' ') AS leaf FROM tok WHERE len(w) >= {MIN_TOKENS} AND trim(array_to_string(w, ' ')) <> ''),
whole AS (SELECT line FROM uses GROUP BY line HAVING count(DISTINCT text) >= {MIN_DOCS}),
leaves AS (SELECT leaf FROM uses GROUP BY leaf HAVING count(DISTINCT text) >= {MIN_DOCS}),
inside AS (SELECT u.* FROM uses u JOIN leaves USING (leaf) WHERE NOT EXISTS (SELECT 1 FROM whole x WHERE x.line = u.line)),
tokens AS (SELECT text, spot, leaf, n, unnest(range(1, n + 1)) AS place, unnest(w) AS token FROM inside),
levels AS (SELECT leaf, place, token, CAST(floor(log2(count(DISTINCT text) / {MIN_DOCS}.0) + 1e-9) AS INT) AS level FROM tokens WHERE token <> '{VARIABLE}' GROUP BY leaf, place, token HAVING count(DISTINCT text) >= {MIN_DOCS}),
leveled AS (SELECT text, spot, leaf, n, place, token, level FROM tokens JOIN levels USING (leaf, place, token)),
least AS (SELECT DISTINCT text, spot, level AS least FROM leveled),
shaped AS (SELECT text, spot, leaf, least, string_agg(place || ':' || token, ' ' ORDER BY place) AS template FROM leveled JOIN least USING (text, spot)
  WHERE level >= least GROUP BY text, spot, leaf, n, least HAVING count(*) >= n * {CONSTANT}::DOUBLE),
again AS (SELECT leaf, template FROM shaped GROUP BY leaf, template HAVING count(DISTINCT text) >= {MIN_DOCS}),
drops AS (SELECT text, list(DISTINCT spot) AS dropped FROM (SELECT text, spot FROM uses JOIN whole USING (line) UNION ALL SELECT text, spot FROM shaped JOIN again USING (leaf, template)) GROUP BY text),
parts AS (SELECT doc_id, d.text, string_split(d.text, chr(10)) AS l, dropped FROM documents d LEFT JOIN drops x ON x.text = d.text)
SELECT doc_id, CAST(coalesce(len(list_filter(l, lambda x: trim(x) <> '')), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(dropped), 0) AS BIGINT) AS n_dropped,
  CASE WHEN dropped IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(len(l)), lambda k: NOT list_contains(dropped, k)), lambda k: l[k + 1]), chr(10)) END AS text
FROM parts
"""

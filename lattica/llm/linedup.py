"""Recurring lines: a fixed-depth template tree over lines, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import materialize, read

#: Texts that differ and hold a template before it counts as recurring; leading tokens below the token count in the tree.
MIN_TEXTS, LEAD = 10, 3
WILD = "<*>"
_SPACE = r"[ \t\r]+"


def _masked(line: Column) -> Column:
    """The line without outer blanks, and with a variable for each token that has a digit; tokens are tried at their starts only."""
    bare = F.btrim(line, F.lit(" \t\r"))
    return F.when(line.rlike("[0-9]"), F.regexp_replace(bare, r"(?<![^ \t\r])[^ \t\r0-9]*+[0-9][^ \t\r]*+", WILD)).otherwise(bare)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key of id and text, and a name of the text."""
    return docs.withColumn("_lines_key", F.xxhash64("doc_id", "text")).withColumn("_lines_same", F.xxhash64("text", F.length("text")))


def _few(df: DataFrame) -> DataFrame:
    """df in an eighth of the shuffle partitions, or 24: for each file an executor starts processes that set its mode, and a
    process that has just been started is counted with all the executor's memory."""
    return df.coalesce(max(24, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))


def recurring_lines(keyed: DataFrame, min_texts: int = MIN_TEXTS, lead: int = LEAD, *, keep_first: bool = False) -> DataFrame:
    """(key, pos): the lines of keyed(docs) whose template recurs in at least min_texts texts that differ.

    The tree: a line's token count, then its leading tokens, in which those with a digit are variable. A leaf's template
    has at each place the token of at least half of its lines, or a variable; with constants at half of the places or
    more, it takes the lines that agree with four fifths of its constants. Lines that are equal but for tokens with
    digits are a template too, so a leaf may hold several. Only counts are gathered: by leaf, by place and token, and by
    template; lines of leaves that too few texts share are left aside first.
    """
    lines = keyed.where("text IS NOT NULL").select("key", "doc_id", "same", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.where(F.col("line").rlike(r"[^ \t\r]")).withColumn("t", F.split(_masked(F.col("line")), _SPACE))
    lines = lines.select("key", "doc_id", "same", "pos", "t", F.xxhash64(F.size("t"), F.slice("t", 1, lead)).alias("leaf"), F.xxhash64(F.concat_ws(" ", "t"), F.lit(1)).alias("whole"))
    often = lambda rows, by: rows.select(by, "same").distinct().groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") >= min_texts).select(by)
    leaves = materialize(_few(often(lines, "leaf")), "leaves")
    # Texts are read again rather than moved: only lines of the leaves that are left are written.
    tokens = materialize(lines.join(leaves, "leaf"), "live-lines")
    each = tokens.select("leaf", "key", "pos", F.size("t").alias("n"), F.posexplode("t").alias("place", "token"))
    votes = each.groupBy("leaf", "n", "place", "token").agg(F.count("*").alias("c"))
    modes = votes.groupBy("leaf", "n", "place").agg(F.max(F.struct("c", "token")).alias("m"), F.sum("c").alias("all")).where((2 * F.col("m.c") >= F.col("all")) & (F.col("m.token") != WILD)).select("leaf", "n", "place", F.col("m.token").alias("token"))
    per_leaf = modes.groupBy("leaf", "n").agg(F.map_from_entries(F.collect_list(F.struct("place", "token"))).alias("constants")).where(2 * F.size("constants") >= F.col("n"))
    templates = materialize(_few(per_leaf.select("leaf", "constants")), "templates")  # one row for a leaf, as long as its lines
    hits = F.aggregate(F.map_entries("constants"), F.lit(0), lambda a, e: a + F.when(F.element_at("t", e["key"] + 1) == e["value"], 1).otherwise(0))
    marked = tokens.join(templates, "leaf", "left").select("key", "doc_id", "same", "pos", "whole", F.when(10 * hits >= 8 * F.size("constants"), F.col("leaf")).alias("fits"))
    marked = materialize(_few(marked), "marked-lines")
    often2 = lambda by: often(marked.where(F.col(by).isNotNull()), by).withColumn(f"{by}_often", F.lit(True))
    wholes, fits = materialize(_few(often2("whole")), "wholes"), materialize(_few(often2("fits")), "fits")
    # Most lines fit no template: for the join they go by their own name, so that they do not meet in one task.
    marked = marked.withColumn("by", F.coalesce("fits", "whole")).join(fits.withColumnRenamed("fits", "by"), "by", "left")
    marked = marked.withColumn("fits_often", F.col("fits_often") & F.col("fits").isNotNull())
    out = marked.join(wholes, "whole", "left").where("fits_often OR whole_often")
    out = out.select("key", "pos", "doc_id", F.when(F.col("fits_often"), F.col("fits")).otherwise(F.col("whole")).alias("template"))
    if keep_first:
        first = out.groupBy("template").agg(F.min(F.struct("doc_id", "key", "pos")).alias("f")).select("f.key", "f.pos")
        out = out.join(materialize(_few(first), "first-lines"), ["key", "pos"], "left_anti")
    return out.select("key", "pos")


def drop_recurring_lines(docs: DataFrame, min_texts: int = MIN_TEXTS, lead: int = LEAD, *, keep_first: bool = False, counts: tuple[str, str] | None = ("n_lines", "n_dropped")) -> DataFrame:
    """docs(doc_id, text, ...) with recurring lines taken out of text; same rows and columns, and two counts of lines.

    keep_first: a template's first line (by doc_id, then place) stays, so that the copies of a text do not lose all. Blank
    lines always stay. A null text stays null, with no lines; an empty one has one. Repeated rows count as one text, and
    all of them lose the same lines. counts: names of the columns with the lines and the dropped lines of a text, which
    replace columns of these names; None: no counts, and no column is replaced.
    """
    keyed = _keyed(docs)
    own = keyed.select(F.col("_lines_key").alias("key"), F.col("_lines_same").alias("same"), "doc_id", "text")
    gone = recurring_lines(own, min_texts, lead, keep_first=keep_first)
    gone = materialize(_few(gone.groupBy("key").agg(F.collect_set("pos").alias("gone"))), "dropped-lines").toDF("_lines_key", "_lines_gone")
    # Lines to drop grow with the corpus, so texts are sorted towards them at every size.
    d = keyed.join(gone.hint("merge"), "_lines_key", "left").withColumn("_lines_all", F.split("text", "\n", -1))
    lines = F.col("_lines_all")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_lines_gone")  # hashed, so long texts stay linear
    kept = F.transform(left, lambda i: F.element_at(lines, i + 1))
    text = F.when(F.col("_lines_gone").isNull(), F.col("text")).otherwise(F.concat_ws("\n", kept))
    names = [c for c in docs.columns if not counts or c not in counts]
    more = [F.when(c.isNull(), 0).otherwise(F.size(c)).cast("long").alias(name) for name, c in zip(counts or (), (lines, F.col("_lines_gone")), strict=False)]
    return d.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in names], *more)


def op5_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, dropped lines and digest of what is left of every text; a null text has no lines, and is empty in the digest."""
    d = drop_recurring_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return _few(d.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL),
k AS (
  SELECT doc_id, text, line, pos, list_transform(string_split_regex(regexp_replace(line, '^[ \t\r]+|[ \t\r]+$', '', 'g'), '[ \t\r]+'),
    lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t FROM l),
n AS (
  SELECT doc_id, text, pos, t, len(t) AS n, len(t) || ' ' || array_to_string(t[1:3], ' ') AS leaf, array_to_string(t, ' ') AS whole
  FROM k WHERE t[1] <> ''),
leaves AS (SELECT leaf FROM n GROUP BY leaf HAVING count(DISTINCT text) >= 10),
live AS (SELECT n.* FROM n SEMI JOIN leaves USING (leaf)),
e AS (SELECT leaf, n, doc_id, pos, unnest(range(n)) AS place, unnest(t) AS token FROM live),
v AS (SELECT leaf, n, place, token, count(*) AS c FROM e GROUP BY ALL),
m AS (
  SELECT leaf, n, place, token, c, sum(c) OVER (PARTITION BY leaf, place) AS total,
    row_number() OVER (PARTITION BY leaf, place ORDER BY c DESC, token DESC) AS r FROM v),
constants AS (SELECT leaf, n, place, token FROM m WHERE r = 1 AND 2 * c >= total AND token <> '<*>'),
good AS (SELECT leaf, count(*) AS k FROM constants GROUP BY leaf, n HAVING 2 * count(*) >= n),
hits AS (
  SELECT e.leaf, e.doc_id, e.pos, good.k, count(*) FILTER (WHERE e.token = c.token) AS h
  FROM e JOIN good USING (leaf) JOIN constants c ON e.leaf = c.leaf AND e.place = c.place GROUP BY ALL),
fit AS (SELECT leaf, doc_id, pos FROM hits WHERE 10 * h >= 8 * k),
marked AS (SELECT live.*, fit.leaf AS fits FROM live LEFT JOIN fit USING (doc_id, pos)),
f AS (SELECT fits FROM marked WHERE fits IS NOT NULL GROUP BY fits HAVING count(DISTINCT text) >= 10),
w AS (SELECT whole FROM marked GROUP BY whole HAVING count(DISTINCT text) >= 10),
gone AS (SELECT DISTINCT doc_id, pos FROM marked WHERE fits IN (SELECT fits FROM f) OR whole IN (SELECT whole FROM w)),
kept AS (
  SELECT l.doc_id, count(g.pos) AS n_dropped, count(*) AS n_lines, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS kept
  FROM l LEFT JOIN gone g USING (doc_id, pos) GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""

"""Line deduplication by a fixed-depth template tree, in DataFrame operations alone.

A line's tokens with digits become variable fields, which makes its form. The tree's levels are the number of tokens and the
leading tokens; a leaf holds several templates. The places after the leading tokens are cut into one segment more than
may differ, so two forms that agree in most places share a segment. Of the forms of a leaf that share a segment the most
frequent leads; a form joins the most frequent of its leaders that it agrees with, and so on up, and the differing places
are variable too. A form that joins none is a template of its own. A line is dropped if a document with a smaller id has a
line of the same template, so the first document keeps it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join, temporary, written

#: Leading tokens of the tree; the share of places where a form must agree with a leader.
DEPTH, AGREEMENT = 4, 0.8
VARIABLE = "<*>"
BLANK = " \\t\\r\\f\\x0B"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _first_doc(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))


def _digest(text: Column | str) -> Column:
    return F.unhex(F.md5(F.col(text) if isinstance(text, str) else text))


def _masked(line: Column) -> Column:
    """The tokens of a line, a space between them, those with digits variable.

    Each pattern reads a line once: one starts at a token's first place only and gives nothing back, the other is tried
    where there is something to join.
    """
    token = f"(?<![^{BLANK}])[^{BLANK}0-9]*+[0-9][^{BLANK}]*+"
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, token, VARIABLE)).otherwise(line)
    joined = F.when(masked.rlike(f"  |[{BLANK.replace(' ', '')}]"), F.regexp_replace(masked, f"[{BLANK}]++", " ")).otherwise(masked)
    return F.trim(joined)


def placed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every line that isn't blank: its document (id and digest of the text), place, masked form, its digest, and its leaf (null: all its tokens lead)."""
    text = F.col(text_col)
    cut = docs.select(_first_doc(id_col).alias("doc"), _digest(text).alias("version"), _lines(text).alias("lines"))
    placed = cut.select("doc", "version", F.posexplode("lines").alias("pos", "line"))  # the digest once a text, not a line
    found = placed.where(F.col("line").rlike(f"[^{BLANK}]")).select("doc", "version", "pos", _masked(F.col("line")).alias("masked"))
    size = F.size(F.split("masked", " "))
    leaf = F.when(size > DEPTH, F.xxhash64(size, F.substring_index("masked", " ", DEPTH)))
    return found.select("doc", "version", "pos", "masked", leaf.alias("leaf")).withColumn("form", _digest("masked"))


def _segments(tokens: Column, n: Column) -> Column:
    """(place, hash) of the segments after the leading tokens; none where no place may differ."""
    differ = n - F.ceil(n * AGREEMENT).cast("int")
    rest = F.greatest(n - DEPTH, F.lit(0))
    start = lambda i: F.floor(i * rest / (differ + 1)).cast("int")
    one = lambda i: F.xxhash64(i, F.slice(tokens, start(i) + DEPTH + 1, start(i + 1) - start(i)))
    return F.when(differ > 0, F.transform(F.sequence(F.lit(0), differ), one))


def templates(lines: DataFrame, forms: DataFrame) -> DataFrame:
    """(form, template) of forms (form, leaf, n) that belong to another form's template; the most frequent form names it."""
    several = forms.where("leaf IS NOT NULL").groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1")
    several = written(several)
    mixed = written(spread_join(forms.select("form", "n", "leaf"), several.select("leaf"), "leaf", counts=several, narrow=True))
    texts = spread_join(lines.select("form", "masked"), mixed.select("form"), "form", counts=mixed.select("form", "n"), narrow=True)
    # the tokens as they are written: a lambda would split the text again for each segment
    mixed = written(mixed.join(texts.distinct(), "form").select("form", "n", "leaf", F.split("masked", " ").alias("tokens")))
    keyed = mixed.select("form", "n", "leaf", F.explode(_segments(F.col("tokens"), F.size("tokens"))).alias("segment"))
    keyed = written(keyed.select("form", "n", F.xxhash64("leaf", "segment").alias("key")))
    leaders = keyed.groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("n"), "form")).alias("first"), F.count("*").alias("forms"))
    leaders = written(leaders.where("forms > 1").select("key", F.col("first.form").alias("leader"), F.col("forms").alias("n")))
    pairs = spread_join(keyed.select("form", "key"), leaders.select("key", "leader"), "key", counts=leaders.select("key", "n"), narrow=True)
    pairs = written(pairs.where("form <> leader").select("form", "leader").distinct())
    counts = pairs.groupBy("leader").agg(F.count("*").alias("n"))
    led = mixed.select(F.col("form").alias("leader"), (-F.col("n")).alias("n"), F.col("tokens").alias("other"))
    pairs = spread_join(pairs.join(mixed.select("form", F.col("tokens").alias("own")), "form"), led, "leader", counts=counts)
    own, other = F.col("own"), F.col("other")
    agree = F.size(F.filter(F.zip_with(own, other, lambda a, b: a == b), lambda x: x)) >= AGREEMENT * F.size(own)
    alike = (F.size(own) == F.size(other)) & (F.slice(own, 1, DEPTH) == F.slice(other, 1, DEPTH)) & agree
    up = written(pairs.where(alike).groupBy("form").agg(F.min(F.struct("n", "leader"))["leader"].alias("template")))
    while True:  # a leader's own leader is more frequent, so this ends; each round doubles the steps
        above = up.select(F.col("form").alias("template"), F.col("template").alias("above"))
        further = written(spread_join(up, above, "template", "left", narrow=True).select("form", F.coalesce("above", "template").alias("template"), F.col("above").isNotNull().alias("moved")))
        up = further.select("form", "template")
        if further.where("moved").isEmpty():
            return up


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, version, drop array<int>): the places of lines whose template an earlier document has."""
    with temporary(docs.sparkSession):
        return _repeated(docs, id_col, text_col)


def _repeated(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    lines = written(placed_lines(docs, id_col, text_col))
    sums = (F.count("*").alias("n"), F.min("doc").alias("first"), F.max("doc").alias("last"), F.min("leaf").alias("leaf"))
    forms = written(lines.groupBy("form").agg(*sums))
    up = templates(lines, forms)
    # forms of one template are summed up; the others stand for themselves
    members = written(up.union(up.select("template", "template").distinct()).toDF("form", "template"))
    one = forms.select("form", F.lit(1).alias("n"))
    grouped = written(spread_join(forms.drop("leaf"), members, "form", counts=one, narrow=True))
    alone = spread_join(forms.where("first < last").drop("leaf"), members, "form", "left", counts=one, narrow=True).where("template IS NULL")
    spans = written(grouped.groupBy("template").agg(F.min("first").alias("earliest"), F.max("last").alias("latest")).where("earliest < latest").select("template", "earliest"))
    ends = spread_join(grouped, spans, "template", narrow=True).where("last > earliest").select("form", "n", "earliest")
    recurring = written(ends.unionByName(alone.select("form", "n", F.col("first").alias("earliest"))))
    hits = spread_join(lines.select("form", "doc", "version", "pos"), recurring.select("form", "earliest"), "form", counts=recurring.select("form", "n"), narrow=True)
    return written(hits.where("doc > earliest").groupBy("doc", "version").agg(F.collect_set("pos").alias("drop")), stays=True)


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated lines gone from the text, and n_lines, n_dropped, which replace columns of these names.

    A null text stays null, an empty one empty; blank lines stay and don't count. Rows of one id are one document: they
    don't repeat each other. A null id comes before all others.
    """
    drop = repeated(docs, id_col, text_col)
    text = F.col(text_col)
    rows = docs.select(F.struct(*docs.columns).alias("row"), text.alias("text"), _first_doc(id_col).alias("doc"), _digest(text).alias("version"))
    joined = rows.join(drop, ["doc", "version"], "left").withColumn("lines", _lines(F.col("text")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    left = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(f"[^{BLANK}\\n][^\\n]*+")))
    n_dropped = F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    columns = [left.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names]
    return joined.select(*columns, n_lines.cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"))


#: DuckDB SQL for (doc_id, n_lines, n_dropped, kept_sha256) of drop_repeated over documents.
ORACLE_SQL = f"""
WITH RECURSIVE placed AS (
  SELECT doc_id, CAST(u.pos AS INTEGER) AS pos, u.line AS line
  FROM (SELECT doc_id, text, unnest(list_transform(range(len(string_split(text, chr(10)))), lambda i: {{'pos': i, 'line': string_split(text, chr(10))[i + 1]}})) AS u FROM documents)
), tokens AS (
  SELECT doc_id, pos, list_filter(regexp_split_to_array(regexp_replace(line, '[^{BLANK}]*[0-9][^{BLANK}]*', '{VARIABLE}', 'g'), '[{BLANK}]+'), lambda x: x <> '') AS t
  FROM placed WHERE regexp_matches(line, '[^{BLANK}]')
), lines AS (
  SELECT doc_id, pos, array_to_string(t, ' ') AS masked FROM tokens
), forms AS (
  SELECT masked, md5(masked) AS form, string_split(masked, ' ') AS t, len(string_split(masked, ' ')) AS size,
    count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM lines GROUP BY masked
), places AS (
  SELECT *, array_to_string(list_prepend(CAST(size AS VARCHAR), t[1:{DEPTH}]), ' ') AS leaf, CAST(size - ceil(size * {AGREEMENT}) AS INTEGER) AS differ
  FROM forms WHERE size > {DEPTH}
), keyed AS (
  SELECT form, n, t, leaf, CAST(i AS INTEGER) AS i, array_to_string(t[CAST(floor(i * (size - {DEPTH}) / (differ + 1)) AS INTEGER) + {DEPTH + 1}:
    CAST(floor((i + 1) * (size - {DEPTH}) / (differ + 1)) AS INTEGER) + {DEPTH}], ' ') AS segment
  FROM (SELECT *, unnest(range(differ + 1)) AS i FROM places WHERE differ > 0)
), leaders AS (
  SELECT leaf, i, segment, form AS leader, n AS leader_n, t AS leader_t
  FROM keyed QUALIFY row_number() OVER (PARTITION BY leaf, i, segment ORDER BY n DESC, form) = 1
), pairs AS (
  SELECT k.form, l.leader, l.leader_n FROM keyed k JOIN leaders l USING (leaf, i, segment)
  WHERE k.form <> l.leader AND len(list_filter(list_zip(k.t, l.leader_t), lambda p: p[1] = p[2])) >= {AGREEMENT} * len(k.t)
), up AS (
  SELECT form, leader FROM pairs QUALIFY row_number() OVER (PARTITION BY form ORDER BY leader_n DESC, leader) = 1
), climbed AS (
  SELECT form, leader, 1 AS step FROM up UNION ALL SELECT c.form, u.leader, step + 1 FROM climbed c JOIN up u ON u.form = c.leader
), templates AS (
  SELECT f.masked, f.first, coalesce(c.leader, f.form) AS template
  FROM forms f LEFT JOIN (SELECT form, arg_max(leader, step) AS leader FROM climbed GROUP BY form) c USING (form)
), spans AS (
  SELECT template, min(first) AS first FROM templates GROUP BY template
), dropped AS (
  SELECT l.doc_id, l.pos FROM lines l JOIN templates t USING (masked) JOIN spans s ON s.template = t.template WHERE l.doc_id > s.first
), kept AS (
  SELECT p.doc_id, string_agg(p.line, chr(10) ORDER BY p.pos) AS text FROM placed p ANTI JOIN dropped d ON d.doc_id = p.doc_id AND d.pos = p.pos GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(x.n, 0) AS BIGINT) AS n_dropped, sha256(CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END) AS kept_sha256
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id) n USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM dropped GROUP BY doc_id) x USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

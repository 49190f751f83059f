"""Dropping lines whose template recurs across documents.

Lines go down a tree of fixed depth: by their number of tokens, then by their leading tokens, where
a token with a digit counts as a variable field. In a leaf, a token keeps its place in the template
if enough documents have it there, and is a variable field otherwise. A template that enough
documents share is boilerplate, and its lines are dropped from all of them.

A line has up to two templates. The close one keeps every constant token and is made where nearly
all tokens are constant. The wide one keeps only the tokens that half of the leaf has in that place, so
several fields of a template may vary; it is made where such a token follows the leading ones and
half of the line is settled, fields with a digit included. A line with neither stands for itself.

Only Spark's own functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import SPACES, WORD, table, word_count
from corpusmill.operators.skew import lookup_join
from corpusmill.session import stage

LEADING = 3  # tokens that the tree follows
DOCUMENTS = 10  # that make a token constant and a template recurring
CONSTANT = 0.8  # share of a line's tokens that must be constant for a close template
FIRM = 0.5  # share of a leaf's lines that must have a token in its place for a wide template
SETTLED = 0.5  # share of a line's tokens that must be leading, firm, or a field with a digit
WORDS = 4  # leading or firm tokens without a digit, at least, of a wide template
FIELD = "<*>"


def _masked(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.lit(FIELD)).otherwise(t))


def _tokens(line: Column) -> Column:
    return F.filter(F.split(line, SPACES), lambda t: t != "")


def _lines(docs: DataFrame) -> DataFrame:
    """One row for each line that has a token: (doc, pos, line, leaf)."""
    lines = docs.select(
        _document().alias("doc"),
        F.xxhash64("text").alias("mark"),
        F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"),
    )
    head = F.regexp_extract("line", rf"^[\x20\x09-\x0D]*((?:{WORD}{SPACES}){{0,{LEADING - 1}}}{WORD})", 1)
    leaf = F.xxhash64(word_count(F.col("line")), _masked(F.split(head, SPACES)))
    return lines.where(F.col("line").rlike(WORD)).withColumn("leaf", leaf)


def _document() -> Column:
    """What counts as a document; a null id stands for its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))


def recurring_lines(docs: DataFrame) -> DataFrame:
    """(doc, mark, pos) of every line of ``docs`` whose template recurs, staged."""
    lines = _lines(docs)
    alive = (
        lines.select("leaf", "doc")
        .distinct()
        .groupBy("leaf")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= DOCUMENTS)
    )
    held = lookup_join(lines, stage(alive, "leaves"), ["leaf"], "n", "inner")
    masked = _masked(_tokens(F.col("line")))
    held = stage(held.select("doc", "mark", "pos", "leaf", F.array_join(masked, " ").alias("line")), "lines")

    variants = stage(
        held.select("leaf", "line", "doc").distinct().groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("n")),
        "variants",
    )
    at = variants.select("leaf", "line", "n", F.posexplode(F.split("line", " ")).alias("place", "token"))
    later = at.where(F.col("place") >= LEADING)
    constant = (
        later.where(F.col("token") != FIELD)
        .groupBy("leaf", "place", "token")
        .agg(F.sum("n").alias("support"))
        .where(F.col("support") >= DOCUMENTS)
    )
    sizes = stage(variants.groupBy("leaf").agg(F.sum("n").alias("heat")), "leaf-sizes")
    sizes = sizes.withColumn("of", F.col("heat"))
    constant = lookup_join(stage(constant, "constants"), sizes, ["leaf"], "heat", "inner")
    constant = constant.withColumn("firm", F.col("support") >= F.col("of") * F.lit(FIRM)).drop("of")
    known = lookup_join(
        later.drop("n"), stage(constant, "firm-constants"), ["leaf", "place", "token"], "support", "inner"
    )
    fixed = known.groupBy("leaf", "line").agg(
        F.sort_array(F.collect_list(F.struct("place", "token", "firm"))).alias("fixed")
    )
    templates = variants.join(fixed, ["leaf", "line"], "left").select(
        "leaf", "line", F.explode(_templates()).alias("template")
    )
    templates = stage(templates, "templates")

    several = templates.groupBy("leaf", "line").agg(F.collect_list("template").alias("made"))
    several = stage(several.withColumn("heat", F.lit(1)), "templates-of-lines")
    of_line = lookup_join(held, several, ["leaf", "line"], "heat", "inner")
    documents = of_line.select("leaf", F.explode("made").alias("template"), "doc").distinct()
    recurring = (
        documents.groupBy("leaf", "template")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= DOCUMENTS)
    )
    dropped = (
        templates.join(recurring, ["leaf", "template"]).groupBy("leaf", "line").agg(F.max("n").alias("n"))
    )
    found = lookup_join(held, stage(dropped, "dropped"), ["leaf", "line"], "n", "inner")
    return stage(found.select("doc", "mark", "pos"), "recurring")


def _templates() -> Column:
    """The line's close and wide templates: its leading tokens and those that stay, with their places.
    The line itself if it has neither."""
    tokens = F.split("line", " ")
    lead = F.slice(tokens, 1, LEADING)
    fixed = F.coalesce(F.col("fixed"), F.array().cast("array<struct<place:int,token:string,firm:boolean>>"))
    firm = F.filter(fixed, lambda f: f["firm"])
    n_lead = F.size(F.filter(lead, lambda t: t != FIELD))
    n_fields = F.size(F.filter(tokens, lambda t: t == FIELD))

    def made(kind: str, stays: Column) -> Column:
        places = F.transform(stays, lambda f: F.concat_ws(":", f["place"].cast("string"), f["token"]))
        return F.concat_ws(" ", F.lit(FIELD), F.lit(kind), F.array_join(lead, " "), F.array_join(places, " "))

    close = n_lead + F.size(fixed) >= F.size(tokens) * CONSTANT
    words = n_lead + F.size(firm)
    wide = (F.size(firm) > 0) & (words >= WORDS) & (words + n_fields >= F.size(tokens) * SETTLED)
    both = F.array_compact(F.array(F.when(close, made("close", fixed)), F.when(wide, made("wide", firm))))
    return F.when(F.size(both) > 0, both).otherwise(F.array(F.col("line")))


def without_recurring(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) of each row of ``docs``, the text without those lines.

    A null text has no lines and stays null; the other lines stay as they are, in order, joined by
    line breaks; blank lines are never dropped. Repeated rows count as one document.
    """
    marked = docs.select("doc_id", "text", _document().alias("doc"), F.xxhash64("text").alias("mark"))
    gone = recurring_lines(docs).distinct().groupBy("doc", "mark").agg(
        F.sort_array(F.collect_list("pos")).alias("gone")
    )
    joined = marked.join(gone, ["doc", "mark"], "left").withColumn(
        "gone", F.coalesce("gone", F.array().cast("array<int>"))
    )
    # the stretches between lost lines are slices, so the work follows the lines, not their square
    joined = joined.withColumn("lines", F.split("text", "\n", -1))
    lines = F.col("lines")
    starts = F.concat(F.array(F.lit(1)), F.transform("gone", lambda p: p + 2))
    ends = F.concat(F.col("gone"), F.array(F.size(lines)))
    kept = F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(lines, s, e - s + 1)))
    return joined.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("bigint").alias("n_lines"),
        F.size("gone").cast("bigint").alias("n_dropped"),
        F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return without_recurring(docs).select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


SQL = """
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line,
         generate_subscripts(string_split(text, chr(10)), 1) as pos
  from documents where text is not null),
cut as (
  select doc_id, pos, line,
         list_transform(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda t: t <> ''),
                        lambda t: case when regexp_matches(t, '[0-9]') then '<*>' else t end) as masked
  from lines),
leafed as (
  select doc_id, pos, line, masked, [len(masked)::varchar] || masked[1:3] as leaf from cut),
alive as (
  select leaf from leafed where len(masked) > 0 group by leaf having count(distinct doc_id) >= 10),
held as (select * from leafed semi join alive using (leaf)),
variants as (select leaf, masked, count(distinct doc_id) as n from held group by all),
places as (
  select leaf, masked, n, unnest(masked) as token, generate_subscripts(masked, 1) as place from variants),
totals as (select leaf, sum(n) as total from variants group by leaf),
constants as (
  select p.leaf, place, token, sum(n) >= 0.5 * any_value(total) as firm
  from places p join totals t on p.leaf = t.leaf
  where place > 3 and token <> '<*>' group by all having sum(n) >= 10),
fixed as (
  select p.leaf, p.masked, list(p.place || ':' || p.token order by p.place) as fixed,
         coalesce(list(p.place || ':' || p.token order by p.place) filter (firm), []) as firm
  from places p join constants c on p.leaf = c.leaf and p.place = c.place and p.token = c.token
  group by p.leaf, p.masked),
counted as (
  select v.leaf, v.masked, coalesce(f.fixed, []) as fixed, coalesce(f.firm, []) as firm, len(v.masked) as size,
         len(list_filter(v.masked[1:3], lambda t: t <> '<*>')) as lead,
         len(list_filter(v.masked, lambda t: t = '<*>')) as fields
  from variants v left join fixed f on v.leaf = f.leaf and v.masked = f.masked),
judged as (
  select *, lead + len(fixed) >= 0.8 * size as close,
         len(firm) > 0 and lead + len(firm) >= 4 and lead + len(firm) + fields >= 0.5 * size as wide
  from counted),
templates as (
  select leaf, masked, ['close'] || masked[1:3] || fixed as template from judged where close
  union all
  select leaf, masked, ['wide'] || masked[1:3] || firm from judged where wide
  union all
  select leaf, masked, ['line'] || masked from judged where not close and not wide),
placed as (
  select h.doc_id, h.pos, h.leaf, t.template from held h
  join templates t on h.leaf = t.leaf and h.masked = t.masked),
recurring as (
  select leaf, template from placed group by all having count(distinct doc_id) >= 10),
gone as (select distinct doc_id, pos from placed semi join recurring using (leaf, template)),
kept as (
  select l.doc_id, count(*) as n_lines, count(g.pos) as n_dropped,
         coalesce(string_agg(l.line, chr(10) order by l.pos) filter (g.pos is null), '') as text
  from lines l left join gone g on l.doc_id = g.doc_id and l.pos = g.pos group by l.doc_id)
select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_dropped, 0)::bigint as n_dropped,
       sha256(coalesce(k.text, '')) as kept_sha256
from documents d left join kept k on d.doc_id = k.doc_id"""

"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe.functions.presence import STAND_INS
from meshframe.llm import groups, leak, packing, sentences, setjoin, survive
from meshframe.llm.words import fold
from meshframe.runtime import cut, read


#: Similarity of p1: 7 / 10, and the least number of ids in a set.
P1 = (7, 10)
P1_LEAST = 4


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    member, found = setjoin.classes(setjoin.sides(read(spark, d, "inode")), P1_LEAST)
    found = cut(found)
    return setjoin.expand(member, found, cut(setjoin.class_pairs(found, *P1)))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each node's class of equal sets per side, and the number of other classes that overlap with it."""
    member, found = setjoin.classes(setjoin.sides(read(spark, d, "inode")), P1_LEAST)
    found = cut(found)
    return setjoin.links(member, found, cut(setjoin.class_pairs(found, *P1)))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.components(read(spark, d, "match_edge"), "a", "b")


def p2_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Number of groups by their size."""
    x = p2_found(spark, d).groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"))
    return x.groupBy("group_size").agg(F.count(F.lit(1)).alias("n_groups"))


def _survivors(spark: SparkSession, d: str) -> DataFrame:
    return survive.node_survivors(read(spark, d, "node_record"), read(spark, d, "feed_trust"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    fields = [F.struct(F.lit(f).alias("field"), F.col(f)["rec_id"].alias("rec_id")) for f in ("node_value", "name", "str_metric")]
    return _survivors(spark, d).select("uid", F.inline(F.array(*fields))).where("rec_id is not null")


def p4_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The surviving node of each UID with several rows; the values as text."""
    value = F.concat_ws(",", F.transform(F.col("node_value")["value"], lambda v: F.coalesce(F.format_number(v, 3), F.lit("null"))))
    return _survivors(spark, d).select("uid", "n_rows", F.when(F.col("node_value").isNotNull(), value).alias("node_value"), F.col("name")["value"].alias("name"), F.col("str_metric")["value"].alias("str_metric"))


#: Capacity of p6's containers in tokens, and where the ranks of the tokenizer that measures texts are unless the session's
#: setting spark.meshframe.tokenizer names another file.
P6_CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A mixture to train on: half of a window's tokens from these sources, the other half from all the rest by their sizes.
P6_TARGETS = {"stackpond": 0.25, "wiki_import": 0.125, "codebarn": 0.125}
#: Containers of a window of the mixture.
P6_WINDOW = 16
#: Containers beyond the least number, as a share of it.
P6_SPARE = 0.01


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return packing.measured(read(spark, d, "documents"), spark.conf.get("spark.meshframe.tokenizer", TOKENIZER))


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sizes(spark, d), P6_CAPACITY)


def p6_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Packed so that windows hold P6_TARGETS while the sources last."""
    return packing.pack(_sizes(spark, d), P6_CAPACITY, P6_TARGETS, P6_WINDOW)


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """Texts that p6_pack places, and how often it breaks a rule of packing."""
    return packing.faults(p6_pack(spark, d), P6_CAPACITY, P6_SPARE)


def p6_mixture_checks(spark: SparkSession, d: str) -> DataFrame:
    """The same of p6_mixture, with the windows off their targets."""
    return packing.faults(p6_mixture(spark, d), P6_CAPACITY, P6_SPARE, P6_TARGETS, P6_WINDOW)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaks(read(spark, d, "documents"), read(spark, d, "eval_item"))


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    return leak.removal_spans(read(spark, d, "documents"), read(spark, d, "eval_item"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(read(spark, d, "documents"))


def p8_unmarked(spark: SparkSession, d: str) -> DataFrame:
    """The same, with units that lack an end mark divided by the model over all gaps between words."""
    return sentences.sentences(read(spark, d, "documents"), divide_unmarked=True)


QUERIES = {f.__name__: f for f in (p1_found, p1_classes, p2_found, p2_sizes, p4_found, p4_nodes, p6_pack, p6_mixture, p6_checks, p6_mixture_checks, p7_found, p7_spans, p8_found, p8_unmarked)}

_WORDS = ", ".join("'" + s.replace("'", "''") + "'" for s in STAND_INS)


def _present(c: str) -> str:
    bare = rf"lower(regexp_replace({c}, '^[\s\p{{Z}}\p{{C}}]+|[\s\p{{Z}}\p{{C}}]+$', '', 'g'))"
    return rf"coalesce(regexp_matches({bare}, '[\p{{L}}\p{{N}}]') and {bare} not in ({_WORDS}), false)"


_RECORDS = f"""
  select r.rec_id, nullif(lower(regexp_replace(r.uid, '[^A-Za-z0-9]', '', 'g')), '') as uid, r.node_value, r.meta.name as name,
         r.meta.str_metric as str_metric, t.trust, r.meta.date_metric as d,
         coalesce(len(list_filter(r.node_value, lambda x: x is not null and not isnan(x))) > 0, false) as has_value,
         {_present("r.meta.name")} as has_name, {_present("r.meta.str_metric")} as has_metric
  from node_record r left join feed_trust t on r.meta.feed = t.feed
"""


def _best(has: str, cols: str) -> str:
    return f"select uid, {cols} from r where {has} qualify row_number() over (partition by uid order by trust desc nulls last, d desc nulls last, rec_id) = 1"


_SETS = """
  s as (select side, id, max(list_sort(list_distinct(list_filter(v, lambda x: x is not null)))) as v
        from (select 'in' as side, id, in_ids as v from inode union all select 'out', id, out_ids from inode)
        where id is not null and v is not null and len(list_distinct(list_filter(v, lambda x: x is not null))) >= 4 group by 1, 2),
  e as (select side, id, len(v) as n, unnest(v) as x from s),
  p as (select a.side, a.id as node_lo, b.id as node_hi from e a join e b on a.side = b.side and a.x = b.x and a.id < b.id
        group by a.side, a.id, b.id, a.n, b.n having 10 * count(*) >= 7 * (a.n + b.n - count(*)))
"""

_LINKED = """
with recursive e as (select a, b from match_edge where a <> b union select b, a from match_edge where a <> b),
  n as (select a as id from match_edge where a is not null union select b from match_edge where b is not null),
  g as (select id, id as other from n union select e.b, g.other from g join e on e.a = g.id where g.other < e.b),
  best as (select id as node_id, min(other) as group_id from g group by 1)
"""

def _folded() -> str:
    """Rows (c, f) of the characters that words() compares in another form, f. Hangul stays composed: alike on both sides."""
    codes = [*range(0x41, 0x5B), *range(0x80, 0xAC00), *range(0xF900, 0x1FFFF), *range(0xE0000, 0xE0200)]
    pairs = [(chr(i), f) for i in codes if (f := fold(chr(i))) != chr(i)]
    return ", ".join(f"({ord(c)}, '{f.replace(chr(39), chr(39) * 2)}')" for c, f in pairs)


_GRAMS = f"""fold as (select chr(i) as c, f from (values {_folded()}) t(i, f)),
  texts as (select true as is_item, item_id as id, text, row_number() over () as r from eval_item where item_id is not null and text is not null
    union all select false, doc_id, text, -row_number() over () from documents where text is not null),
  chars as (select r, unnest(regexp_extract_all(text, '(?s).')) as c, unnest(range(length(text))) as pos from texts),
  parts as (select r, pos, unnest(regexp_extract_all(f, '(?s).')) as c, unnest(range(length(f))) as k from (select r, pos, coalesce(f, c) as f from chars left join fold using (c)) where f <> ''),
  runs as (select *, regexp_full_match(c, '[\\p{{L}}\\p{{N}}]') as is_word, sum(case when is_word then 0 else 1 end) over (partition by r order by pos, k) as run from parts),
  words as (select r, row_number() over (partition by r order by run) as n, string_agg(c, '' order by pos, k) as w, min(pos) as a, max(pos) + 1 as b from runs where is_word group by r, run),
  grams as (select r, n, a, last_value(b) over t as b, string_agg(w, ' ') over t as g, count(*) over t as size from words window t as (partition by r order by n rows between current row and {leak.LENGTH - 1} following)),
  hits as (select distinct d.r, d.n, d.a, d.b, x.id as item_id from grams i join texts x on x.r = i.r join grams d on d.g = i.g where i.r > 0 and d.r < 0 and i.size = {leak.LENGTH} and d.size = {leak.LENGTH})"""

_PLACED = """select 'texts' as what, count(distinct doc_id) as n from documents where text is not null
union all select unnest(['texts in parts missing or repeated', 'containers beyond capacity', 'containers out of order', 'too many containers']), 0"""

SQL = {
    "p6_checks": _PLACED,
    "p6_mixture_checks": f"{_PLACED} union all select 'windows off target', 0",
    "p7_found": f"with {_GRAMS} select t.id as doc_id, item_id from (select distinct r, item_id from hits) h join texts t using (r)",
    "p7_spans": f"""with {_GRAMS}, gaps as (select *, case when n - lag(n) over (partition by r order by n) <= {leak.LENGTH} then 0 else 1 end as new from (select distinct r, n, a, b from hits)),
  spans as (select *, sum(new) over (partition by r order by n) as span from gaps),
  whole as (select r, span, min(n) as n0, max(n) as n1, min(a) as start_pos, max(b) as end_pos from spans group by 1, 2)
select t.id as doc_id, start_pos, end_pos, n1 + {leak.LENGTH} - n0 as n_words, array_to_string(list_sort(list(distinct item_id)), ',') as items
from whole w join hits h on h.r = w.r and h.n between n0 and n1 join texts t on t.r = w.r group by w.r, t.id, start_pos, end_pos, n0, n1""",
    "p1_found": f"with {_SETS} select side, node_lo, node_hi from p",
    "p1_classes": f"""
with {_SETS}, c as (select side, id, v, min(id) over (partition by side, v) as class_id from s),
  l as (select side, k, count(distinct o) as n from (
      select p.side, a.class_id as k, b.class_id as o from p join c a on a.side = p.side and a.id = node_lo join c b on b.side = p.side and b.id = node_hi
      union all select p.side, b.class_id, a.class_id from p join c a on a.side = p.side and a.id = node_lo join c b on b.side = p.side and b.id = node_hi) where k <> o group by 1, 2)
select c.side, c.id as node_id, c.class_id, coalesce(l.n, 0) as n_links from c left join l on l.side = c.side and l.k = c.class_id""",
    "p2_found": f"{_LINKED} select node_id, group_id from best",
    "p2_sizes": f"{_LINKED} select group_size, count(*) as n_groups from (select group_id, count(*) as group_size from best group by 1) group by 1",
    "p4_found": f"""
with r as (select *, count(*) over (partition by uid) as n from ({_RECORDS}) where uid is not null qualify n >= 2)
select uid, 'node_value' as field, rec_id from ({_best("has_value", "rec_id")})
union all select uid, 'name', rec_id from ({_best("has_name", "rec_id")})
union all select uid, 'str_metric', rec_id from ({_best("has_metric", "rec_id")})""",
    "p4_nodes": f"""
with r as (select *, count(*) over (partition by uid) as n from ({_RECORDS}) where uid is not null qualify n >= 2),
  v as ({_best("has_value", "node_value")}), m as ({_best("has_name", "name")}), s as ({_best("has_metric", "str_metric")})
select u.uid, u.n as n_rows,
  array_to_string(list_transform(v.node_value, lambda x: coalesce(case when isnan(x) then 'NaN' else format('{{:,.3f}}', x) end, 'null')), ',') as node_value, m.name, s.str_metric
from (select distinct uid, n from r) u left join v using (uid) left join m using (uid) left join s using (uid)""",
}

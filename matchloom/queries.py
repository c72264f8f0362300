"""Registered queries of the linkage operators over the driver's tables, and their SQL.

Documents and parts serve as records, line items as scored pairs (see the views below).  Doubles are rounded on both
sides, since sums depend on their order in the last digits.

All read whole texts and whole tables; candidate searches use the caps of the plans (``blocking_cap`` shows a small one).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import text as tx
from matchloom.operators import blocking, chargram, compete, context, decide, duplicates, features, keys, labels, metrics, records, select, splits, stats
from matchloom.schema import BITS, CHANNELS, EXTRA_CHANNELS
from matchloom.scratch import held

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return put


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    return frame.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in frame.dtypes))


# ---------------------------------------------------------------- views

DOC_RECORDS = """doc_records AS (
  SELECT concat('S', CAST(substr(source, 4) AS INT) % 3 + 1, '-', doc_id) AS entity_id, CAST(substr(source, 4) AS INT) % 3 + 1 AS src, doc_id AS id,
         split_part(text, chr(10), 1) AS business_name, substr(text, length(split_part(text, chr(10), 1)) + 2) AS business_address, lang AS country
  FROM documents)"""
PART_RECORDS = """part_records AS (
  SELECT concat('S', p_partkey % 3 + 1, '-', p_partkey) AS entity_id, p_partkey % 3 + 1 AS src, p_partkey AS id, p_name AS business_name,
         concat(p_size, ' ', p_type, ' rd, ', p_brand, ' ', p_partkey) AS business_address, p_type AS country FROM part)"""


def _fold(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_\\s]+', ' ', 'g')), '\\s+', ' ', 'g'))"


def _words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _numbers(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '\\p{{Nd}}+'), lambda n: CASE WHEN ltrim(n, '0') = '' THEN '0' ELSE ltrim(n, '0') END)"


def prepared_sql(table: str, record_view: str) -> str:
    return f"""WITH {record_view},
folded AS (SELECT *, CAST(src AS BIGINT) * 2000000000 + id AS code, {_fold('business_name')} AS nf, {_fold('business_address')} AS af FROM {table}),
p AS (SELECT *, CASE WHEN length(g) >= 6 THEN g ELSE '' END AS glued FROM (SELECT *,
  list_sort(list_distinct(list_filter({_words('nf')}, lambda t: length(t) >= 3))) AS ntok,
  list_sort(list_distinct(list_filter({_words('af')}, lambda t: length(t) >= 4 AND NOT regexp_full_match(t, '\\p{{Nd}}+')))) AS atok,
  list_sort(list_distinct({_numbers('business_address')})) AS nums,
  array_to_string(list_filter({_words('nf')}, lambda t: t NOT IN {_in(tx.GLUE_DROP)}), '') AS g FROM folded))"""


DOCS, PARTS = prepared_sql("doc_records", DOC_RECORDS), prepared_sql("part_records", PART_RECORDS)


def doc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    src, name = F.expr("cast(substr(source, 4) as int) % 3 + 1"), F.split_part("text", F.lit("\n"), F.lit(1))
    rest = F.substr("text", F.length(name) + 2)
    return d.select(F.concat(F.lit("S"), src, F.lit("-"), "doc_id").alias("entity_id"), name.alias("business_name"), rest.alias("business_address"), F.col("lang").alias("country"))


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    address = F.concat("p_size", F.lit(" "), "p_type", F.lit(" rd, "), "p_brand", F.lit(" "), "p_partkey")
    return p.select(F.concat(F.lit("S"), F.col("p_partkey") % 3 + 1, F.lit("-"), "p_partkey").alias("entity_id"), F.col("p_name").alias("business_name"), address.alias("business_address"), F.col("p_type").alias("country"))


def prep(frame: DataFrame) -> DataFrame:
    return records.prepared(records.with_codes(frame))


CAP, K, K_WIDE, K_FORMULA = 3000, 25, 150, 10  # those of the plans


def docs(spark, sf_dir) -> DataFrame:
    return prep(doc_records(spark, sf_dir))


def parts(spark, sf_dir) -> DataFrame:
    return prep(part_records(spark, sf_dir))


def sides(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    return p.filter("source = 1").withColumn("anchor", F.col("id")), p.filter("source <> 1")


PAIR_VIEW = """pairs AS (
  SELECT l_orderkey AS anchor, l_partkey AS target, min(l_suppkey % 2 + 2) AS source, max(round(l_discount * 10, 2)) AS p,
         max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS label, max(l_quantity) AS q, max(l_tax) AS tax
  FROM lineitem GROUP BY l_orderkey, l_partkey),
anchors AS (SELECT o.o_orderkey AS anchor, o.o_orderpriority AS country, coalesce(n, 0) AS n_true FROM orders o
  LEFT JOIN (SELECT anchor, sum(label) AS n FROM pairs GROUP BY anchor) t ON t.anchor = o.o_orderkey)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")  # noqa: E741
    return l.groupBy(F.col("l_orderkey").alias("anchor"), F.col("l_partkey").alias("target")).agg(
        F.min(F.col("l_suppkey") % 2 + 2).alias("source"),
        F.max(F.round(F.col("l_discount") * 10, 2)).alias("p"),
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("label"),
        F.max("l_quantity").alias("q"),
        F.max("l_tax").alias("tax"),
    )


def anchors(spark: SparkSession, sf_dir: str, scored: DataFrame) -> DataFrame:
    n = scored.groupBy("anchor").agg(F.sum("label").alias("n_true"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("anchor"), F.col("o_orderpriority").alias("country"))
    return o.join(n, "anchor", "left").fillna(0, ["n_true"])


# ---------------------------------------------------------------- records and text


@query(f"WITH {DOC_RECORDS} SELECT entity_id, src AS source, id, CAST(src AS BIGINT) * 2000000000 + id AS code FROM doc_records")
def records_scan(spark, sf_dir):
    return records.with_codes(doc_records(spark, sf_dir)).select("entity_id", F.col("source").cast("int").alias("source"), "id", "code")


@query(f"WITH {DOC_RECORDS} SELECT entity_id, count(*) AS n FROM doc_records GROUP BY entity_id HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return doc_records(spark, sf_dir).groupBy("entity_id").agg(F.count("*").alias("n")).filter("n > 1")


def _truth_lists(spark, sf_dir) -> DataFrame:
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")  # noqa: E741
    lists = l.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("S2-"), "l_partkey"))), ",").alias("matched_entity_ids"))
    return lists.select(F.concat(F.lit("S1-"), "l_orderkey").alias("source1_entity_id"), "matched_entity_ids")


@query("""
WITH e AS (SELECT l_orderkey AS a, l_partkey AS t FROM lineitem), o AS (SELECT o_orderkey AS a FROM orders),
tr AS (SELECT DISTINCT a FROM e), known AS (SELECT p_partkey AS t FROM part)
SELECT 'truth_without_record' AS problem, (SELECT count(*) FROM tr WHERE a NOT IN (SELECT a FROM o)) AS n
UNION ALL SELECT 'record_without_truth', (SELECT count(*) FROM o WHERE a NOT IN (SELECT a FROM tr))
UNION ALL SELECT 'unknown_target', (SELECT count(*) FROM e WHERE t NOT IN (SELECT t FROM known))
UNION ALL SELECT 'repeated_in_list', (SELECT count(*) FROM (SELECT a, t FROM e GROUP BY a, t HAVING count(*) > 1))
UNION ALL SELECT 'claimed_twice', (SELECT count(*) FROM (SELECT t FROM (SELECT DISTINCT a, t FROM e) GROUP BY t HAVING count(*) > 1))""")
def truth_audit(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("S1-"), "o_orderkey").alias("entity_id"))
    t = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("S2-"), "p_partkey").alias("entity_id"))
    return labels.truth_audit(o, t, _truth_lists(spark, sf_dir))


@query("""SELECT concat('S1-', l_orderkey) AS source1_entity_id, concat('S2-', l_partkey) AS target_entity_id, count(*) AS n FROM lineitem GROUP BY ALL""")
def truth_edges(spark, sf_dir):
    return labels.truth_edges(_truth_lists(spark, sf_dir)).groupBy("source1_entity_id", "target_entity_id").agg(F.count("*").alias("n"))


@query("SELECT l_partkey AS code, count(DISTINCT l_orderkey) AS anchors FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_orderkey) > 1")
def exclusive_targets(spark, sf_dir):
    return labels.exclusive(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("code"), F.col("l_orderkey").alias("anchor")))


@query(f"{DOCS} SELECT entity_id, nf AS folded, glued, coalesce(nullif(array_to_string(list_filter({_words('nf')}, lambda t: t NOT IN {_in(tx.LEGAL_SUFFIXES)}), ' '), ''), nf) AS nosuffix FROM p")
def name_views(spark, sf_dir):
    return docs(spark, sf_dir).select("entity_id", F.col("nf").alias("folded"), "glued", F.col("name_ns").alias("nosuffix"))


def _expand(x: str) -> str:
    table = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in tx.ADDRESS_WORDS.items()) + "}"
    return f"array_to_string(list_transform({_words(x)}, lambda t: coalesce({table}[t], t)), ' ')"


@query(f"""{PARTS} SELECT entity_id, {_expand('af')} AS expanded, array_to_string(list_sort(list_distinct({_numbers('af')})), ' ') AS nums,
  array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(af, '\\p{{Nd}}+'), lambda n: length(n) IN (5, 6)))), ' ') AS postal FROM p""")
def address_views(spark, sf_dir):
    return parts(spark, sf_dir).select("entity_id", F.col("addr").alias("expanded"), F.array_join(F.array_sort("nums"), " ").alias("nums"), F.array_join("postal", " ").alias("postal"))


@query("""SELECT o_orderkey, regexp_replace(concat(o_orderkey, '-', o_custkey, ' 00', o_orderkey), '([0-9])-([0-9])', '\\1\\2', 'g') AS joined,
  CASE WHEN ltrim(substr(CAST(o_orderkey AS VARCHAR), 2), '0') = '' THEN '0' ELSE ltrim(substr(CAST(o_orderkey AS VARCHAR), 2), '0') END AS bare FROM orders""")
def number_forms(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", tx.join_hyphens(F.concat("o_orderkey", F.lit("-"), "o_custkey", F.lit(" 00"), "o_orderkey")).alias("joined"), tx.without_zeros(F.substring(F.col("o_orderkey").cast("string"), 2, 30)).alias("bare"))


# ---------------------------------------------------------------- statistics and keys

FREQ = """rows AS (SELECT country, 'n' AS field, unnest(ntok) AS token FROM p UNION ALL SELECT country, 'a', unnest(atok) FROM p),
freq AS (SELECT field, country AS scope, token, count(*) AS df FROM rows GROUP BY ALL HAVING count(*) >= 2
  UNION ALL SELECT field, '*', token, count(*) FROM rows GROUP BY ALL HAVING count(*) >= 2)"""


@query(f"{DOCS}, {FREQ} SELECT field, scope, token, df FROM freq")
def token_freq(spark, sf_dir):
    return stats.token_freq(docs(spark, sf_dir))


@query(f"""{PARTS}, {FREQ}, known AS (SELECT DISTINCT scope AS country FROM freq WHERE scope <> '*'),
t AS (SELECT p.code, u.token, coalesce(f.df, 1) AS df FROM p, unnest(p.ntok) AS u(token)
  LEFT JOIN known k ON k.country = p.country LEFT JOIN freq f ON f.field = 'n' AND f.token = u.token AND f.scope = coalesce(k.country, '*'))
SELECT code, string_agg(token, ' ' ORDER BY df, length(token) DESC, token) AS tokens FROM t GROUP BY code""")
def rarity_order(spark, sf_dir):
    p = parts(spark, sf_dir)
    return stats.in_rarity_order(p, stats.token_freq(p)).filter(F.size("ntok") > 0).select("code", F.array_join("ntok", " ").alias("tokens"))


def _pairs_sql(x: str, n: int) -> str:
    f = f"{x}[1:{n}]"
    return f"flatten(list_transform({f}, lambda x: list_transform(list_filter({f}, lambda y: y > x), lambda y: x || '|' || y)))"


KEY_SQL = {
    "name_exact": "CASE WHEN nf <> '' THEN [nf] ELSE [] END",
    "name_sorted": "CASE WHEN nf <> '' AND len(ntok) > 0 THEN [array_to_string(ntok, ' ')] ELSE [] END",
    "name_token": "ntok[1:6]",
    "name_pair": _pairs_sql("ntok", 4),
    "addr_token": "list_transform(atok[1:6], lambda t: 'a|' || t)",
    "num_token": "flatten(list_transform(nums[1:2], lambda n: list_transform(atok[1:3], lambda t: n || '|' || t)))",
    "num_set": "CASE WHEN len(nums) > 0 THEN ['#|' || array_to_string(nums, '-')] ELSE [] END",
    "name_num": "flatten(list_transform(ntok[1:3], lambda t: list_transform(nums[1:2], lambda n: t || '|' || n)))",
    "name_glued": "CASE WHEN glued <> '' THEN ['g|' || glued] ELSE [] END",
    "addr_exact": "CASE WHEN length(af) >= 8 THEN ['x|' || af] ELSE [] END",
    "addr_pair": f"list_transform({_pairs_sql('atok', 3)}, lambda t: 'ap|' || t)",
    "addr_nonum": "list_transform(list_filter([array_to_string(list_sort(list_distinct(list_filter(string_split(af, ' '), lambda t: t <> '' AND NOT regexp_matches(t, '\\p{Nd}')))), ' ')], lambda x: length(x) >= 10), lambda x: 'an|' || x)",
    "num_trunc": "CASE WHEN len(atok) > 0 THEN list_transform(list_filter(nums, lambda n: length(n) >= 3)[1:3], lambda n: 'nt|' || n[1:2] || '|' || atok[1]) ELSE [] END",
}
CHANNEL_ROWS = " UNION ALL ".join(f"SELECT code, id, src, country, '{c}' AS channel, unnest({KEY_SQL[c]}) AS key FROM p" for c in CHANNELS)


def _key_query(channel: str, source, prelude: str) -> None:
    @query(f"{prelude} SELECT code, country, unnest({KEY_SQL[channel]}) AS key FROM p", f"keys_{channel}")
    def run(spark, sf_dir, **how):
        return keys.keys(source(spark, sf_dir, **how), (channel,)).drop("channel")


for _c in CHANNELS + EXTRA_CHANNELS:
    _key_query(_c, *((docs, DOCS) if _c in ("name_exact", "name_sorted", "name_token", "name_pair", "name_glued", "addr_exact") else (parts, PARTS)))

BLOCKS = f"k AS ({CHANNEL_ROWS}), tk AS (SELECT * FROM k WHERE src <> 1), ak AS (SELECT id AS anchor, * FROM k WHERE src = 1), blk AS (SELECT country, channel, key, count(*) AS size FROM tk GROUP BY ALL)"


def _hits(cap: int) -> str:
    bits = "CASE b.channel " + " ".join(f"WHEN '{c}' THEN {BITS[c]}" for c in CHANNELS) + " END"
    return f"""scored AS (SELECT a.anchor, t.code, any_value(t.src) AS source, CAST(round(sum(CAST(CAST(ln(1e7) - ln(b.size) AS FLOAT) AS DOUBLE)), 4) AS FLOAT) AS score, bit_or({bits}) AS channels
  FROM ak a JOIN blk b ON b.size <= {cap} AND a.country = b.country AND a.channel = b.channel AND a.key = b.key JOIN tk t ON t.country = b.country AND t.channel = b.channel AND t.key = b.key GROUP BY a.anchor, t.code)"""


def _top(k: int) -> str:
    return f"top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor, source ORDER BY score DESC, code) - 1 AS ret_rank FROM scored) WHERE ret_rank < {k})"


def _key_sides(p: DataFrame, channels=CHANNELS) -> tuple[DataFrame, DataFrame]:
    a, t = sides(p)
    return keys.keys(a, channels, ("anchor",)), keys.keys(t, channels, ("code",))


@query(f"{DOCS}, {BLOCKS} SELECT country, channel, key, size FROM blk")
def block_sizes(spark, sf_dir):
    return blocking.block_sizes(_key_sides(docs(spark, sf_dir))[1])


@query(f"{PARTS}, {BLOCKS} SELECT channel, count(*) AS keys, round(avg(size), 6) AS mean_size, round(quantile_cont(CAST(size AS DOUBLE), 0.99), 6) AS p99_size, max(size) AS max_size FROM blk GROUP BY channel")
def block_profile(spark, sf_dir):
    return rounded(blocking.block_profile(_key_sides(parts(spark, sf_dir))[1]))


def _held_keyed(p: DataFrame, columns: tuple[str, ...] = (), channels=CHANNELS) -> tuple[DataFrame, DataFrame]:
    """Anchors and targets with some columns and their keys, long ones as digests, held once; their texts are not."""
    short = F.transform(keys.key_array(channels), lambda k: F.struct(k["channel"].alias("channel"), keys.short(k["key"]).alias("key")))
    return sides(held(p.select("source", "id", "code", "country", *columns, short.alias("keys"))))


def _unfolded(a: DataFrame, t: DataFrame) -> tuple[DataFrame, DataFrame]:
    return a.select("anchor", "country", F.inline("keys")), t.select("code", "country", F.inline("keys"))


def _held_sides(p: DataFrame, channels=CHANNELS) -> tuple[DataFrame, DataFrame]:
    return _unfolded(*_held_keyed(p, (), channels))


def _candidates(p: DataFrame, cap: int, k: int) -> DataFrame:
    return blocking.candidates(*_held_sides(p), cap, k)


TOP = "SELECT anchor, code, CAST(source AS INT) AS source, round(CAST(score AS DOUBLE), 3) AS score, CAST(channels AS INT) AS channels, CAST(ret_rank AS INT) AS ret_rank FROM top"


def _shown(c: DataFrame) -> DataFrame:
    return c.select("anchor", "code", F.col("source").cast("int").alias("source"), F.round(F.col("score").cast("double"), 3).alias("score"), F.col("channels").cast("int").alias("channels"), F.col("ret_rank").cast("int").alias("ret_rank"))


@query(f"{DOCS}, {BLOCKS}, {_hits(CAP)}, {_top(K)} {TOP}")
def blocking_topk(spark, sf_dir, cap=CAP, k=K):
    return _shown(_candidates(docs(spark, sf_dir), cap, k))


@query(f"{PARTS}, {BLOCKS}, {_hits(8)}, {_top(10)} {TOP}")
def blocking_cap(spark, sf_dir):
    return _shown(_candidates(parts(spark, sf_dir), 8, 10))


@query(f"""{DOCS}, {BLOCKS}, {_hits(CAP)}, {_top(K)}, n AS (SELECT country, channel, key, size FROM blk),
tn AS (SELECT t.code, t.channel, n.size FROM tk t JOIN n USING (country, channel, key)), an AS (SELECT a.anchor, a.channel, n.size FROM ak a JOIN n USING (country, channel, key))
SELECT c.anchor, c.code, coalesce(t1.size, 0) AS t_name_cnt, coalesce(t2.size, 0) AS t_addr_cnt, coalesce(a1.size, 0) AS a_name_cnt, coalesce(a2.size, 0) AS a_addr_cnt FROM top c
LEFT JOIN tn t1 ON t1.code = c.code AND t1.channel = 'name_exact' LEFT JOIN tn t2 ON t2.code = c.code AND t2.channel = 'addr_exact'
LEFT JOIN an a1 ON a1.anchor = c.anchor AND a1.channel = 'name_exact' LEFT JOIN an a2 ON a2.anchor = c.anchor AND a2.channel = 'addr_exact'""")
def pool_counts(spark, sf_dir, cap=CAP, k=K):
    a, t = _held_sides(docs(spark, sf_dir))
    return blocking.pool_counts(blocking.candidates(a, t, cap, k), a, t).select("anchor", "code", "t_name_cnt", "t_addr_cnt", "a_name_cnt", "a_addr_cnt")


@query(f"{DOCS}, {BLOCKS}, {_hits(CAP)}, {_top(K)} SELECT entity_id FROM p WHERE code IN (SELECT code FROM top)")
def needed_records(spark, sf_dir, cap=CAP, k=K):
    p = docs(spark, sf_dir)
    return blocking.needed_records(p, _candidates(p, cap, k)).select("entity_id")


@query(f"""{DOCS}, {BLOCKS}, {_hits(CAP)}, {_top(K_WIDE)},
f AS (SELECT c.*, coalesce(len(list_intersect(a.ntok, t.ntok)) / nullif(len(list_distinct(list_concat(a.ntok, t.ntok))), 0), 0) + 1e-6 * CAST(c.score AS DOUBLE) AS formula
  FROM top c JOIN p a ON a.src = 1 AND a.id = c.anchor JOIN p t ON t.code = c.code),
r AS (SELECT *, row_number() OVER (PARTITION BY anchor, source ORDER BY round(formula, 9) DESC, code) AS fr FROM f)
SELECT anchor, code, CAST(ret_rank AS INT) AS ret_rank FROM r WHERE ret_rank < {K} OR fr <= {K_FORMULA}""")
def formula_select(spark, sf_dir, cap=CAP, k=K, k_wide=K_WIDE, k_formula=K_FORMULA):
    a, t = _held_keyed(docs(spark, sf_dir), ("ntok",))
    return select.select_by_tokens(a, t, *_unfolded(a, t), cap, k, k_wide, k_formula).select("anchor", "code", "ret_rank")


_EXTRA = "addr_pair"


@query(f"""{PARTS}, {BLOCKS}, {_hits(CAP)}, {_top(K)},
xk AS (SELECT code, id, src, country, unnest({KEY_SQL[_EXTRA]}) AS key FROM p),
xb AS (SELECT country, key, count(*) AS size FROM xk WHERE src <> 1 GROUP BY ALL HAVING count(*) <= {CAP}),
xs AS (SELECT a.id AS anchor, t.code, any_value(t.src) AS source, CAST(round(sum(CAST(CAST(ln(1e7) - ln(b.size) AS FLOAT) AS DOUBLE)), 4) AS FLOAT) AS score
  FROM xk a JOIN xb b USING (country, key) JOIN xk t USING (country, key) WHERE a.src = 1 AND t.src <> 1 GROUP BY a.id, t.code),
xt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor, source ORDER BY score DESC, code) AS rn FROM xs) WHERE rn <= 2)
SELECT coalesce(c.anchor, x.anchor) AS anchor, coalesce(c.code, x.code) AS code, round(CAST(coalesce(c.score, x.score) AS DOUBLE), 3) AS score,
  CAST(coalesce(c.channels, 0) | CASE WHEN x.code IS NULL THEN 0 ELSE {BITS[_EXTRA]} END AS INT) AS channels, CAST(coalesce(c.ret_rank, 150) AS INT) AS ret_rank
FROM top c FULL JOIN xt x ON c.anchor = x.anchor AND c.code = x.code""")
def extra_channel_quota(spark, sf_dir, cap=CAP, k=K, extra_cap=CAP):
    a, t = _held_sides(parts(spark, sf_dir), CHANNELS + (_EXTRA,))
    found = select.add_quota(blocking.candidates(a, t, cap, k, CHANNELS), blocking.candidates(a, t, extra_cap, 2, (_EXTRA,)), 150)
    return _shown(found).drop("source")


@query()
def seed_expansion(spark, sf_dir):
    """The character-gram search of part records, seeded with the best match of each anchor; tested on a fixture."""
    a, t = sides(held(parts(spark, sf_dir)))
    given = blocking.candidates(keys.keys(a, CHANNELS, ("anchor",)), keys.keys(t, CHANNELS, ("code",)), CAP, 1)
    sure = held(given.select("anchor", "code", F.lit(1.0).alias("p"), F.lit(True).alias("keep")))  # the views are read twice
    return chargram.seeded_candidates(a, t, sure).select("anchor", "code", F.round("score", 2).alias("score"), F.col("rank").cast("int").alias("rank"))


@query()
def chargram_topk(spark, sf_dir):
    """Name and address grams with the operator's own caps; tested on a fixture."""
    d, n = doc_records(spark, sf_dir), spark.sparkContext.defaultParallelism
    d = d.repartition(n) if d.rdd.getNumPartitions() < n else d  # a table of one file would be read by one task
    a, t = sides(held(prep(d).select("source", "id", "code", "country", "glued", "nf", "af")))  # texts of no other views
    found = chargram.gram_candidates(chargram.gram_rows(a, "anchor"), chargram.gram_rows(t, "code"), t)
    return found.select("anchor", "code", F.round("score", 2).alias("score"), "shared")


# ---------------------------------------------------------------- similarities and pair features


def _name_pairs(spark, sf_dir) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    prev = p.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_name").alias("t"))
    return p.join(prev, "p_partkey").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("a"), "t")


@query("SELECT x.p_partkey AS k, round(jaro_winkler_similarity(x.p_name, y.p_name), 6) AS sim FROM part x JOIN part y ON x.p_partkey = y.p_partkey + 1")
def sim_jaro_winkler(spark, sf_dir):
    from matchloom.functions.similarity import similarity

    return rounded(_name_pairs(spark, sf_dir).select("k", similarity("jw")("a", "t").alias("sim")))


@query()
def sim_ratio_and_sets(spark, sf_dir):
    from matchloom.functions.similarity import similarity

    return rounded(_name_pairs(spark, sf_dir).select("k", *(similarity(x)("a", "t").alias(x) for x in ("ratio", "tsort", "tset"))))


WEIGHTED = f"""{PARTS}, {FREQ}, known AS (SELECT DISTINCT scope AS country FROM freq WHERE scope <> '*'),
w AS (SELECT p.code, p.id, p.src, u.token, ln(1e7) - ln(coalesce(f.df, 1)) AS w FROM p, unnest(p.ntok) AS u(token)
  LEFT JOIN known k ON k.country = p.country LEFT JOIN freq f ON f.field = 'n' AND f.token = u.token AND f.scope = coalesce(k.country, '*')),
c AS (SELECT a.code AS a, b.code AS t FROM p a JOIN p b ON b.id = a.id + 5)"""


@query(f"""{WEIGHTED}, m AS (SELECT c.a, c.t, x.token, x.w AS wa, y.w AS wt FROM c JOIN w x ON x.code = c.a LEFT JOIN w y ON y.code = c.t AND y.token = x.token
  UNION ALL SELECT c.a, c.t, y.token, NULL, y.w FROM c JOIN w y ON y.code = c.t LEFT JOIN w x ON x.code = c.a AND x.token = y.token WHERE x.token IS NULL)
SELECT a, t, round(count(*) FILTER (wa IS NOT NULL AND wt IS NOT NULL) / count(*), 6) AS jacc,
  round(coalesce(sum(greatest(wa, wt)) FILTER (wa IS NOT NULL AND wt IS NOT NULL), 0) / sum(greatest(coalesce(wa, 0), coalesce(wt, 0))), 6) AS wov,
  round(coalesce(max(greatest(wa, wt)) FILTER (wa IS NOT NULL AND wt IS NOT NULL), 0) / ln(1e7), 6) AS wshared_max,
  round(coalesce(sum(wa) FILTER (wt IS NULL), 0) / sum(wa), 6) AS wmiss_a, round(coalesce(sum(wt) FILTER (wa IS NULL), 0) / sum(wt), 6) AS wmiss_t
FROM m GROUP BY a, t HAVING count(wa) > 0 AND count(wt) > 0""")
def token_overlap(spark, sf_dir):
    p = parts(spark, sf_dir)
    w = features.token_weights(p, stats.token_freq(p), "code", "ntok", "n")
    at = p.select(F.col("code").alias("a"), (F.col("id") + 5).alias("id")).join(p.select("id", F.col("code").alias("t")), "id")
    both = at.join(w.withColumnsRenamed({"code": "a", "weights": "wa"}), "a").join(w.withColumnsRenamed({"code": "t", "weights": "wt"}), "t")
    return rounded(both.withColumn("o", features.token_overlap(F.col("wa"), F.col("wt"))).filter("o is not null").select("a", "t", "o.*"))


NUMBER_PAIRS = """n AS (SELECT p_partkey AS k, CASE WHEN p_size = p_partkey THEN [CAST(p_size AS VARCHAR)] ELSE [CAST(p_size AS VARCHAR), CAST(p_partkey AS VARCHAR)] END AS x,
  CASE WHEN p_partkey // 10 = p_size + 1 THEN [CAST(p_size + 1 AS VARCHAR)] ELSE [CAST(p_partkey // 10 AS VARCHAR), CAST(p_size + 1 AS VARCHAR)] END AS y FROM part)"""


def _number_pairs(spark, sf_dir) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    tenth = F.floor(F.col("p_partkey") / 10)
    text = lambda *c: F.array_distinct(F.array(*(x.cast("string") for x in c)))
    x, y = text(F.col("p_size"), F.col("p_partkey")), text(tenth, F.col("p_size") + 1)
    return p.select(F.col("p_partkey").alias("k"), x.alias("nums_a"), y.alias("nums_t"), x.alias("nums_j_a"), y.alias("nums_j_t"), x.alias("postal_a"), x.alias("postal_t"))


@query(f"""WITH {NUMBER_PAIRS}, d AS (SELECT k, x, y, len(list_intersect(x, y)) AS sh,
  flatten(list_transform(x, lambda a: list_transform(y, lambda b: CASE WHEN greatest(CAST(a AS DOUBLE), CAST(b AS DOUBLE)) = 0 THEN 0 ELSE abs(CAST(a AS DOUBLE) - CAST(b AS DOUBLE)) / greatest(CAST(a AS DOUBLE), CAST(b AS DOUBLE)) END))) AS gaps,
  flatten(list_transform(x, lambda a: list_transform(y, lambda b: length(a) >= 2 AND length(b) >= 2 AND abs(length(a) - length(b)) = 1 AND (starts_with(a, b) OR starts_with(b, a))))) AS cuts FROM n)
SELECT k, CAST(sh AS DOUBLE) AS num_shared, round(sh / (len(x) + len(y) - sh), 6) AS num_jacc, CAST(x[1] = y[1] AS DOUBLE) AS num_first_equal, CAST(sh = 0 AS DOUBLE) AS num_conflict,
  round(least(1.0, list_min(gaps)), 6) AS num_min_reldiff, CAST(list_contains(cuts, true) AS DOUBLE) AS num_prefix FROM d""")
def number_block(spark, sf_dir):
    e = features.number_evidence()
    return rounded(_number_pairs(spark, sf_dir).select("k", *(e[c].alias(c) for c in ("num_shared", "num_jacc", "num_first_equal", "num_conflict", "num_min_reldiff", "num_prefix"))))


@query(f"WITH {NUMBER_PAIRS} SELECT k, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS numj_jacc, CAST(x[1] = y[1] AS DOUBLE) AS numj_first_equal FROM n")
def joined_numbers(spark, sf_dir):
    e = features.joined_numbers()
    return rounded(_number_pairs(spark, sf_dir).select("k", *(e[c].alias(c) for c in e)))


def _counted_pairs(p: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Held candidates, and the records of both sides with their pool counts."""
    (a, t), (ak, tk) = sides(p), _held_sides(p)
    return held(blocking.candidates(ak, tk, home=True)), blocking.counted(a, ak, tk, "anchor", "a"), blocking.counted(t, tk, tk, "code", "t")


@query()
def pair_features(spark, sf_dir):
    p = held(parts(spark, sf_dir))  # keys, frequencies and both sides read it
    return rounded(features.features(*_counted_pairs(p), stats.token_freq(p)), 4)


@query()
def cheap_pair_features(spark, sf_dir):
    return rounded(features.cheap_features(*_counted_pairs(held(parts(spark, sf_dir)))), 4)


# ---------------------------------------------------------------- context, claims, decisions

CONTEXT_VIEW = f"""{PAIR_VIEW}, c AS (SELECT anchor, target AS code, source, q AS ret_score, CASE WHEN tax > 0.06 THEN NULL ELSE p END AS name_tset, CASE WHEN q > 40 THEN NULL ELSE tax * 10 END AS addr_tset FROM pairs),
v AS (SELECT *, coalesce(name_tset, 0) AS n0, coalesce(addr_tset, 0) AS a0, coalesce((name_tset + addr_tset) / 2, name_tset, addr_tset) AS av FROM c)"""


def _context_pairs(spark, sf_dir) -> DataFrame:
    return pairs(spark, sf_dir).select(
        "anchor", F.col("target").alias("code"), "source", F.col("q").alias("ret_score"), F.when(F.col("tax") <= 0.06, F.col("p")).alias("name_tset"),
        F.when(F.col("q") <= 40, F.col("tax") * 10).alias("addr_tset"),
    )


def _lead_sql(v: str) -> str:
    best, second = f"max({v}) OVER (PARTITION BY anchor)", f"nth_value({v}, 2) OVER (PARTITION BY anchor ORDER BY {v} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"round({v} - CASE WHEN {v} = {best} THEN coalesce({second}, 0) ELSE {best} END, 6)"


@query(f"""WITH {CONTEXT_VIEW} SELECT anchor, code, count(*) OVER w AS n_cands, round(max(ret_score) OVER w - ret_score, 6) AS ret_score_gap,
  round(max(n0) OVER w - n0, 6) AS name_tset_gap, round(max(a0) OVER w - a0, 6) AS addr_tset_gap, {_lead_sql('n0')} AS name_tset_lead, {_lead_sql('a0')} AS addr_tset_lead,
  CAST(row_number() OVER (PARTITION BY anchor ORDER BY n0 + a0 DESC, source, ret_score DESC, code) - 1 AS INT) AS combo_rank, round(av, 6) AS avail_mean,
  CAST(CASE WHEN av IS NOT NULL THEN rank() OVER (PARTITION BY anchor, av IS NULL ORDER BY av DESC) - 1 END AS INT) AS avail_rank, round(max(av) OVER w - av, 6) AS avail_gap,
  CAST(CASE WHEN name_tset IS NOT NULL THEN rank() OVER (PARTITION BY anchor, name_tset IS NULL ORDER BY name_tset DESC) - 1 END AS INT) AS name_rank_avail,
  round(ln(1 + sum(CASE WHEN coalesce(av, 0) >= 0.9 THEN 1 ELSE 0 END) OVER w - CASE WHEN coalesce(av, 0) >= 0.9 THEN 1 ELSE 0 END), 6) AS n_strong_rivals
FROM v WINDOW w AS (PARTITION BY anchor)""")
def rival_context(spark, sf_dir):
    out = context.rival_context(_context_pairs(spark, sf_dir))
    return rounded(out.drop("source", "ret_score", "name_tset", "addr_tset", "addr_rank_avail"))


@query(f"""WITH {CONTEXT_VIEW}, t AS (SELECT *, n0 + a0 AS c0 FROM v) SELECT anchor, code, CAST(dense_rank() OVER (PARTITION BY anchor ORDER BY c0 DESC) - 1 AS INT) AS combo_dense_rank,
  CAST(rank() OVER (PARTITION BY anchor ORDER BY c0 DESC) - 1 AS INT) AS combo_competition_rank, count(*) OVER (PARTITION BY anchor, c0) AS combo_ties, round(max(c0) OVER (PARTITION BY anchor) - c0, 6) AS combo_gap,
  CAST(dense_rank() OVER (PARTITION BY anchor ORDER BY n0 DESC) - 1 AS INT) AS name_dense_rank, CAST(dense_rank() OVER (PARTITION BY anchor ORDER BY a0 DESC) - 1 AS INT) AS addr_dense_rank,
  round(least(n0, a0), 6) AS joint_min, round(n0 * a0, 6) AS joint_product, round(greatest(n0, a0), 6) AS joint_max, round(abs(n0 - a0), 6) AS name_addr_disagreement FROM t""")
def tie_context(spark, sf_dir):
    given = _context_pairs(spark, sf_dir).withColumns({"name_ratio": F.lit(0.5), "num_jacc": F.lit(0.5)})
    return rounded(context.tie_context(given).drop("source", "ret_score", "name_tset", "addr_tset", "name_ratio", "num_jacc", "addr_supported_name", "number_supported_name"))


CLAIMS = """claims AS (SELECT anchor, target, label, p, max(p) OVER a AS a_pmax, max(p) OVER a - p AS a_gap, row_number() OVER (PARTITION BY anchor ORDER BY p DESC, target) - 1 AS a_rank,
  sum(CASE WHEN p > 0.5 THEN 1 ELSE 0 END) OVER a AS a_n50, sum(CASE WHEN p > 0.9 THEN 1 ELSE 0 END) OVER a AS a_n90, sum(p) OVER a AS a_psum, count(*) OVER t AS t_nclaims,
  row_number() OVER (PARTITION BY target ORDER BY p DESC, anchor) - 1 AS t_rank, max(p) OVER t AS tbest,
  nth_value(p, 2) OVER (PARTITION BY target ORDER BY p DESC, anchor ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tsecond, sum(CASE WHEN p > 0.5 THEN 1 ELSE 0 END) OVER t AS tn50
  FROM pairs WINDOW a AS (PARTITION BY anchor), t AS (PARTITION BY target)),
comp AS (SELECT *, CASE WHEN t_rank = 0 THEN coalesce(tsecond, 0) ELSE tbest END AS t_best_other, tn50 - CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS t_n50_other FROM claims)"""


@query(f"WITH {PAIR_VIEW}, {CLAIMS} SELECT anchor, target, round(a_pmax, 6) AS a_pmax, round(a_gap, 6) AS a_gap, CAST(a_rank AS INT) AS a_rank, CAST(a_n50 AS BIGINT) AS a_n50, CAST(a_n90 AS BIGINT) AS a_n90, round(a_psum, 6) AS a_psum FROM comp")
def competition_anchor(spark, sf_dir):
    return rounded(compete.competition(pairs(spark, sf_dir)).select("anchor", "target", *compete.ANCHOR_SIDE))


@query(f"WITH {PAIR_VIEW}, {CLAIMS} SELECT anchor, target, t_nclaims, CAST(t_rank AS INT) AS t_rank, round(t_best_other, 6) AS t_best_other, round(p - t_best_other, 6) AS t_margin, CAST(t_n50_other AS BIGINT) AS t_n50_other FROM comp")
def competition_target(spark, sf_dir):
    return rounded(compete.competition(pairs(spark, sf_dir)).select("anchor", "target", *compete.TARGET_SIDE))


OWNER = "owned AS (SELECT *, p >= 0.6 AND row_number() OVER (PARTITION BY target, p >= 0.6 ORDER BY p DESC, anchor) = 1 AS keep FROM pairs)"


def _owned(spark, sf_dir) -> DataFrame:
    return decide.one_owner(decide.threshold(pairs(spark, sf_dir), 0.6))


@query(f"WITH {PAIR_VIEW} SELECT anchor, target, p >= 0.8 AS keep FROM pairs")
def decide_threshold(spark, sf_dir):
    return decide.threshold(pairs(spark, sf_dir), 0.8).select("anchor", "target", "keep")


@query(f"WITH {PAIR_VIEW}, {OWNER} SELECT anchor, target, keep FROM owned")
def decide_one_owner(spark, sf_dir):
    return _owned(spark, sf_dir).select("anchor", "target", "keep")


@query(f"""WITH {PAIR_VIEW}, {OWNER} SELECT anchor, target, keep OR (NOT bool_or(keep) OVER (PARTITION BY anchor) AND row_number() OVER (PARTITION BY anchor ORDER BY p DESC, target) = 1 AND p >= 0.3) AS keep FROM owned""")
def decide_rescue(spark, sf_dir):
    return decide.rescue(_owned(spark, sf_dir), 0.3).select("anchor", "target", "keep")


@query(f"""WITH {PAIR_VIEW}, r AS (SELECT anchor, target, least(greatest(p, 0), 1) AS q, row_number() OVER (PARTITION BY anchor ORDER BY p DESC, target) AS k FROM pairs),
s AS (SELECT *, sum(q) OVER (PARTITION BY anchor ORDER BY k) AS s, sum(q) OVER (PARTITION BY anchor) AS n, exp(sum(ln(greatest(1 - q, 1e-12))) OVER (PARTITION BY anchor)) AS none FROM r),
e AS (SELECT *, CASE WHEN k <= 20 THEN round(CASE WHEN s = 0 AND n = 0 THEN 1.25 * s / (1.25 * s + (k - s) + 0.25 * greatest(n - s, 0)) ELSE 1.25 * s / (1.25 * s + (k - s) + 0.25 * greatest(n - s, 0)) END, 12) ELSE -1 END AS ef FROM s),
b AS (SELECT *, max(ef) OVER (PARTITION BY anchor) AS best FROM e)
SELECT anchor, target, best > round(none, 12) AND k <= min(CASE WHEN ef = best THEN k END) OVER (PARTITION BY anchor) AS keep FROM b""")
def decide_expected_f05(spark, sf_dir):
    return decide.expected_f05(pairs(spark, sf_dir)).select("anchor", "target", "keep")


@query(f"""WITH {PAIR_VIEW}, {OWNER}, free AS (SELECT * FROM pairs WHERE target NOT IN (SELECT target FROM owned WHERE keep) AND p >= 0.5)
SELECT anchor, target FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY p DESC, anchor) AS rn FROM free) WHERE rn = 1""")
def decide_unclaimed(spark, sf_dir):
    claimed = _owned(spark, sf_dir).filter("keep")
    return decide.unclaimed_rescue(pairs(spark, sf_dir), claimed, 0.5).select("anchor", "target")


@query()
def decide_exact_f05(spark, sf_dir):
    return decide.exact_f05(pairs(spark, sf_dir).select("anchor", "target", "p")).select("anchor", "target", "keep")


@query(f"WITH {PAIR_VIEW} SELECT anchor, target, round(1 / (1 + exp(-((ln(x) - ln(1 - x)) / 1.5 + 0.25))), 6) AS p FROM (SELECT anchor, target, least(greatest(p, 1e-12), 1 - 1e-12) AS x FROM pairs)")
def calibrated(spark, sf_dir):
    return rounded(pairs(spark, sf_dir).select("anchor", "target", decide.calibrated(F.col("p"), 1.5, 0.25).alias("p")))


# ---------------------------------------------------------------- metrics

SCORES = f"""{PAIR_VIEW}, {OWNER}, k AS (SELECT anchor, sum(label) AS tp, sum(1 - label) AS fp FROM owned WHERE keep GROUP BY anchor),
scores AS (SELECT *, n_true - tp AS fn, CASE WHEN n_true = 0 THEN CASE WHEN tp + fp = 0 THEN 1.0 ELSE 0.0 END WHEN tp = 0 THEN 0.0 ELSE 1.25 * tp / (1.25 * tp + fp + 0.25 * (n_true - tp)) END AS f05
  FROM (SELECT a.anchor, a.country, a.n_true, coalesce(k.tp, 0) AS tp, coalesce(k.fp, 0) AS fp FROM anchors a LEFT JOIN k ON k.anchor = a.anchor))"""


def _scores(spark, sf_dir) -> DataFrame:
    scored = _owned(spark, sf_dir)
    return metrics.anchor_scores(scored.filter("keep"), anchors(spark, sf_dir, scored))


@query(f"WITH {SCORES} SELECT anchor, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(f05, 6) AS f05 FROM scores")
def metric_entity_f05(spark, sf_dir):
    return rounded(_scores(spark, sf_dir).select("anchor", "tp", "fp", "fn", "f05"))


@query(f"WITH {SCORES} SELECT round(avg(f05), 6) AS macro_f05, round(avg(f05) FILTER (n_true > 0), 6) AS non_singleton, round(avg(f05) FILTER (n_true = 0), 6) AS singleton, round(sum(tp + fp) / count(*), 6) AS pred_per_s1 FROM scores")
def metric_macro(spark, sf_dir):
    return rounded(metrics.macro(_scores(spark, sf_dir)))


@query(f"""WITH {SCORES} SELECT round(avg(f05), 6) AS macro_f05, count(*) AS n_entities, CAST(count(*) FILTER (n_true = 0) AS BIGINT) AS n_singletons, CAST(count(*) FILTER (n_true > 0) AS BIGINT) AS n_non_singletons,
  round(avg(CASE WHEN n_true = 0 THEN 1.0 ELSE 0 END), 6) AS singleton_rate, round(avg(CASE WHEN n_true = 0 THEN 1.0 ELSE 0 END), 6) AS empty_baseline, round(avg(f05) FILTER (n_true = 0), 6) AS singleton_score,
  round(avg(f05) FILTER (n_true > 0), 6) AS non_singleton_score, CAST(sum(tp) AS BIGINT) AS pair_tp, CAST(sum(fp) AS BIGINT) AS pair_fp, CAST(sum(fn) AS BIGINT) AS pair_fn,
  round(sum(tp) / sum(tp + fp), 6) AS pair_precision, round(sum(tp) / sum(tp + fn), 6) AS pair_recall FROM scores""")
def metric_report(spark, sf_dir):
    return rounded(metrics.report(_scores(spark, sf_dir)))


@query(f"WITH {SCORES} SELECT country, count(*) AS n, round(avg(f05), 6) AS macro_f05 FROM scores GROUP BY ROLLUP (country)")
def metric_country_rollup(spark, sf_dir):
    return rounded(metrics.by_country(_scores(spark, sf_dir)))


@query(f"""WITH {PAIR_VIEW}, c AS (SELECT * FROM pairs WHERE p >= 0.3), h AS (SELECT a.anchor, a.n_true, coalesce(sum(label), 0) AS hit, count(c.target) AS cands FROM anchors a LEFT JOIN c ON c.anchor = a.anchor GROUP BY a.anchor, a.n_true),
f AS (SELECT *, CASE WHEN n_true = 0 THEN 1.0 WHEN hit = 0 THEN 0.0 ELSE 1.25 * hit / (1.25 * hit + 0.25 * (n_true - hit)) END AS o, row_number() OVER (ORDER BY cands) - 1 AS pos, count(*) OVER () AS n FROM h)
SELECT round(sum(hit) / sum(n_true), 6) AS pair_blocking_recall, round(avg(hit / n_true) FILTER (n_true > 0), 6) AS mean_per_entity_recall, round(avg(CASE WHEN hit = n_true THEN 1.0 ELSE 0 END) FILTER (n_true > 0), 6) AS full_coverage_rate,
  round(avg(o), 6) AS oracle_macro_f05, CAST(sum(cands) AS BIGINT) AS candidates_total, round(avg(cands), 6) AS candidates_mean, max(cands) AS candidates_max, CAST(sum(n_true - hit) AS BIGINT) AS missed_positives,
  round(1 - sum(cands) / 1000000000, 6) AS reduction_ratio, CAST(max(CASE WHEN pos = floor(0.5 * (n - 1)) THEN cands END) AS DOUBLE) AS candidates_median, CAST(max(CASE WHEN pos = floor(0.95 * (n - 1)) THEN cands END) AS DOUBLE) AS candidates_p95 FROM f""")
def metric_blocking(spark, sf_dir):
    scored = pairs(spark, sf_dir).withColumnRenamed("target", "code")
    return rounded(metrics.blocking(scored.filter("label = 1"), scored.filter("p >= 0.3"), anchors(spark, sf_dir, scored), 1_000_000_000))


GRID = [0.2, 0.4, 0.5, 0.6, 0.8]
SWEEP = f"""{PAIR_VIEW}, grid AS (SELECT unnest({GRID}) AS t), kept AS (SELECT * FROM (SELECT g.t, x.*, row_number() OVER (PARTITION BY g.t, x.target ORDER BY x.p DESC, x.anchor) AS rn FROM pairs x JOIN grid g ON x.p >= g.t) WHERE rn = 1),
k AS (SELECT t, anchor, sum(label) AS tp, sum(1 - label) AS fp FROM kept GROUP BY t, anchor),
swept AS (SELECT g.t, avg(CASE WHEN a.n_true = 0 THEN CASE WHEN coalesce(k.tp + k.fp, 0) = 0 THEN 1.0 ELSE 0.0 END WHEN coalesce(k.tp, 0) = 0 THEN 0.0 ELSE 1.25 * k.tp / (1.25 * k.tp + k.fp + 0.25 * (a.n_true - k.tp)) END) AS macro_f05
  FROM anchors a CROSS JOIN grid g LEFT JOIN k ON k.t = g.t AND k.anchor = a.anchor GROUP BY g.t)"""


def _swept(spark, sf_dir) -> DataFrame:
    scored = pairs(spark, sf_dir)
    return metrics.sweep(scored, anchors(spark, sf_dir, scored), GRID)


@query(f"WITH {SWEEP} SELECT CAST(t AS DOUBLE) AS t, round(macro_f05, 6) AS macro_f05 FROM swept")
def metric_sweep(spark, sf_dir):
    return rounded(_swept(spark, sf_dir))


@query(f"WITH {SWEEP} SELECT CAST(t AS DOUBLE) AS t, round(macro_f05, 6) AS macro_f05 FROM swept ORDER BY round(macro_f05, 12) DESC, t LIMIT 1")
def metric_best_threshold(spark, sf_dir):
    return rounded(metrics.best_threshold(_swept(spark, sf_dir)))


@query(f"""WITH {PAIR_VIEW} SELECT CAST(CASE WHEN p >= 0.97 THEN 0.97 WHEN p >= 0.9 THEN 0.9 WHEN p >= 0.7 THEN 0.7 WHEN p >= 0.5 THEN 0.5 WHEN p >= 0.3 THEN 0.3 WHEN p >= 0.1 THEN 0.1 ELSE 0.0 END AS DOUBLE) AS bucket,
  count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(label), 6) AS mean_label FROM pairs WHERE p < 1.01 GROUP BY 1""")
def metric_calibration(spark, sf_dir):
    return rounded(metrics.calibration(pairs(spark, sf_dir)))


@query(f"""WITH {SCORES}, per AS (SELECT anchor, count(*) AS pairs, sum(CASE WHEN keep THEN 1 ELSE 0 END) AS kept FROM owned GROUP BY anchor)
SELECT a.country, count(*) AS anchors, CAST(coalesce(sum(pairs), 0) AS BIGINT) AS pairs, CAST(coalesce(sum(kept), 0) AS BIGINT) AS kept, CAST(count(*) FILTER (kept > 0) AS BIGINT) AS with_match,
  round(count(*) FILTER (kept > 0) / count(*), 6) AS share, round(coalesce(sum(kept), 0) / count(*), 6) AS kept_per_anchor FROM anchors a LEFT JOIN per ON per.anchor = a.anchor GROUP BY a.country""")
def run_summary(spark, sf_dir):
    scored = _owned(spark, sf_dir)
    return rounded(metrics.run_summary(scored, anchors(spark, sf_dir, scored)))


REASONS = f"""{SCORES}, truth AS (SELECT anchor, target FROM pairs WHERE label = 1), found AS (SELECT * FROM owned),
reasons AS (SELECT t.anchor, t.target, CASE WHEN f.p IS NULL THEN 'not_retrieved' WHEN f.p < 0.6 THEN 'below_threshold' ELSE 'lost_ownership' END AS reason FROM truth t LEFT JOIN found f ON f.anchor = t.anchor AND f.target = t.target WHERE NOT coalesce(f.keep, false)
  UNION ALL SELECT anchor, target, 'false_positive' FROM found WHERE keep AND label = 0)"""


def _reasons(spark, sf_dir) -> DataFrame:
    scored = _owned(spark, sf_dir)
    return metrics.error_reasons(pairs(spark, sf_dir).filter("label = 1"), scored, 0.6)


@query(f"WITH {REASONS} SELECT reason, count(*) AS n FROM reasons GROUP BY reason")
def error_reasons(spark, sf_dir):
    return _reasons(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {REASONS}, c AS (SELECT anchor, count(*) AS errors FROM reasons GROUP BY anchor) SELECT r.reason, count(*) AS n, round(sum((1 - s.f05) / c.errors), 4) AS loss FROM reasons r JOIN c USING (anchor) JOIN scores s USING (anchor) GROUP BY r.reason")
def loss_by_reason(spark, sf_dir):
    return rounded(metrics.loss_by_reason(_reasons(spark, sf_dir), _scores(spark, sf_dir)), 4)


DOC_TRUTH = "truth AS (SELECT a.id AS anchor, CAST(t.src AS BIGINT) * 2000000000 + t.id AS code FROM (SELECT d.*, md5(x.text) AS h FROM doc_records d JOIN documents x ON x.doc_id = d.id) a JOIN (SELECT d.*, md5(x.text) AS h FROM doc_records d JOIN documents x ON x.doc_id = d.id) t ON a.h = t.h AND a.country = t.country WHERE a.src = 1 AND t.src <> 1)"


def doc_truth(spark, sf_dir) -> DataFrame:
    h = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("h"))
    r = records.with_codes(doc_records(spark, sf_dir)).select("id", "source", "code", "country").join(h, "id")
    a, t = r.filter("source = 1").select(F.col("id").alias("anchor"), "h", "country"), r.filter("source <> 1").select("code", "h", "country")
    return a.join(t, ["h", "country"]).select("anchor", "code")


@query(f"{DOCS}, {DOC_TRUTH}, {BLOCKS}, {_hits(CAP)}, {_top(K)} SELECT c.anchor, c.code, CAST(t.code IS NOT NULL AS INT) AS label FROM top c LEFT JOIN truth t ON t.anchor = c.anchor AND t.code = c.code")
def label_pairs(spark, sf_dir, cap=CAP, k=K):
    return labels.label(_candidates(docs(spark, sf_dir), cap, k), doc_truth(spark, sf_dir), ["anchor", "code"]).select("anchor", "code", F.col("label").cast("int").alias("label"))


@query(f"{DOCS}, {DOC_TRUTH}, {BLOCKS}, {_hits(CAP)}, {_top(K)} SELECT t.anchor, t.code FROM truth t LEFT JOIN top c ON t.anchor = c.anchor AND t.code = c.code WHERE c.code IS NULL")
def missing_positives(spark, sf_dir, cap=CAP, k=K):
    return labels.missing_positives(doc_truth(spark, sf_dir), _candidates(docs(spark, sf_dir), cap, k), ["anchor", "code"])


@query(f"{DOCS}, {DOC_TRUTH}, {BLOCKS}, {_hits(CAP)}, {_top(K)} SELECT b.channel, round(avg(CASE WHEN (c.channels & b.bit) <> 0 THEN 1.0 ELSE 0 END), 6) AS share FROM top c JOIN truth t ON t.anchor = c.anchor AND t.code = c.code, (VALUES {', '.join(f"('{c}', {BITS[c]})" for c in CHANNELS)}) AS b(channel, bit) GROUP BY b.channel")
def channel_shares(spark, sf_dir, cap=CAP, k=K):
    found = labels.label(_candidates(docs(spark, sf_dir), cap, k), doc_truth(spark, sf_dir), ["anchor", "code"]).filter("label = 1")
    return rounded(metrics.channel_shares(found, {c: BITS[c] for c in CHANNELS}))


@query(f"{DOCS}, {DOC_TRUTH}, {BLOCKS}, {_hits(CAP)}, {_top(K)} SELECT CASE WHEN c.code IS NULL THEN 'never found' WHEN c.ret_rank < 1 THEN 'below 1' WHEN c.ret_rank < 3 THEN 'below 3' ELSE 'over 3' END AS band, count(*) AS n FROM truth t LEFT JOIN top c ON t.anchor = c.anchor AND t.code = c.code GROUP BY 1")
def rank_depth(spark, sf_dir, cap=CAP, k=K):
    return metrics.rank_depth(doc_truth(spark, sf_dir), _candidates(docs(spark, sf_dir), cap, k), (1, 3))


@query(f"""WITH {PAIR_VIEW}, r AS (SELECT *, row_number() OVER (PARTITION BY anchor, source ORDER BY p DESC, target) AS rn FROM pairs),
h AS (SELECT a.anchor, a.n_true, b.budget, coalesce(sum(r.label), 0) AS hit, count(r.target) AS kept FROM anchors a CROSS JOIN (VALUES (1), (2), (3)) AS b(budget) LEFT JOIN r ON r.anchor = a.anchor AND r.rn <= b.budget GROUP BY ALL)
SELECT budget, CAST(sum(kept) AS BIGINT) AS kept, round(avg(CASE WHEN n_true = 0 THEN 1.0 WHEN hit = 0 THEN 0.0 ELSE 1.25 * hit / (1.25 * hit + 0.25 * (n_true - hit)) END), 6) AS ceiling FROM h GROUP BY budget""")
def budget_ceilings(spark, sf_dir):
    """An order has at most seven pairs here, so the budgets are small."""
    scored = pairs(spark, sf_dir)
    return rounded(metrics.budget_ceilings(scored.withColumnRenamed("target", "code"), anchors(spark, sf_dir, scored), (1, 2, 3)))


@query(f"""WITH {PAIR_VIEW}, x AS (SELECT anchor, target // 3 AS code, source, q AS score, label AS shared FROM pairs),
d AS (SELECT anchor, source, code, max(score) AS score FROM x GROUP BY ALL)
SELECT anchor, CAST(source AS INT) AS source, code, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY anchor, source ORDER BY score DESC, code) - 1 AS INT) AS rank FROM d""")
def rank_distinct(spark, sf_dir):
    given = pairs(spark, sf_dir).select("anchor", F.floor(F.col("target") / 3).alias("code"), "source", F.col("q").alias("score"), F.col("label").alias("shared"))
    out = select.rank_distinct(given)
    return out.select("anchor", F.col("source").cast("int").alias("source"), "code", F.col("score").cast("double").alias("score"), F.col("rank").cast("int").alias("rank"))


@query(f"""WITH {PAIR_VIEW}, r AS (SELECT p.*, CASE WHEN a.country = '1-URGENT' THEN 'val' ELSE 'train' END AS role FROM pairs p JOIN anchors a ON a.anchor = p.anchor WHERE p.p >= 0.3)
SELECT CAST(count(*) FILTER (role = 'train') AS BIGINT) AS train_all, CAST(count(*) FILTER (role = 'train' AND (label = 1 OR p >= 0.5)) AS BIGINT) AS train_kept, CAST(count(*) FILTER (role = 'train' AND label = 1) AS BIGINT) AS train_pos,
  CAST(count(*) FILTER (role = 'val') AS BIGINT) AS val, CAST(count(*) FILTER (role = 'val' AND label = 1) AS BIGINT) AS val_pos,
  round(count(*) FILTER (role = 'val' AND label = 1) / (SELECT greatest(sum(n_true), 1) FROM anchors WHERE country = '1-URGENT'), 6) AS val_blocking_recall FROM r""")
def build_report(spark, sf_dir):
    scored = pairs(spark, sf_dir)
    a = anchors(spark, sf_dir, scored).withColumn("role", F.when(F.col("country") == "1-URGENT", "val").otherwise("train"))
    found = scored.filter("p >= 0.3").join(a.select("anchor", "role"), "anchor")  # blocking's part of the pairs
    return rounded(metrics.build_report(found, found.filter("role = 'train' and (label = 1 or p >= 0.5)"), a))


LEARNING_SIZES = (100, 1000)  # the feature: a learning curve's sizes


@query(f"""WITH {PAIR_VIEW}, a AS (SELECT count(DISTINCT anchor) AS n FROM pairs) SELECT CAST(s.size AS INT) AS size, CAST(least(s.size, a.n) AS BIGINT) AS anchors, CAST(0 AS BIGINT) AS cut FROM a, (VALUES {', '.join(f'({s})' for s in LEARNING_SIZES)}) AS s(size)""")
def learning_curve(spark, sf_dir):
    """For each size, the anchors drawn and those of them whose pairs are not whole."""
    given = pairs(spark, sf_dir)
    whole, out = given.groupBy("anchor").agg(F.count("*").alias("n")), None
    for size in LEARNING_SIZES:
        drawn = splits.learning_subset(given, size).groupBy("anchor").agg(F.count("*").alias("m")).join(whole, "anchor")
        row = drawn.agg(F.lit(size).alias("size"), F.count("*").alias("anchors"), F.count(F.when(F.col("m") != F.col("n"), 1)).alias("cut"))
        out = row if out is None else out.unionByName(row)
    return out


@query()
def bootstrap_interval(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return rounded(metrics.bootstrap(s.select("anchor", (F.col("f05") - 0.5).alias("delta"))), 4)


# ---------------------------------------------------------------- splits, samples, duplicates, outputs


def _split(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    r, truth = records.with_codes(doc_records(spark, sf_dir)), doc_truth(spark, sf_dir)
    truth = truth.groupBy("code").agg(F.min("anchor").alias("anchor")).select("anchor", "code")
    a, t = splits.make_split(r.filter("source = 1").select(F.col("id").alias("anchor"), "country"), r.filter("source <> 1").select("code", "source", "country"), truth)
    return a, t, truth


@query(f"""WITH {DOC_RECORDS}, {DOC_TRUTH}, one AS (SELECT code, min(anchor) AS anchor FROM truth GROUP BY code), n AS (SELECT d.country, coalesce(c.n, 0) AS n FROM doc_records d LEFT JOIN (SELECT anchor, count(*) AS n FROM one GROUP BY anchor) c ON c.anchor = d.id WHERE d.src = 1),
s AS (SELECT country, CASE WHEN n <= 1 THEN n WHEN n <= 3 THEN 2 WHEN n <= 5 THEN 4 ELSE 6 END AS bucket, count(*) AS c FROM n GROUP BY ALL)
SELECT country, CAST(bucket AS INT) AS bucket, CAST(f.fold AS INT) AS fold, CAST((c - f.fold + 4) // 5 AS BIGINT) AS n FROM s, (SELECT unnest(range(5)) AS fold) f WHERE (c - f.fold + 4) // 5 > 0""")
def split_balance(spark, sf_dir):
    a, _, _ = _split(spark, sf_dir)
    return a.groupBy("country", "bucket", F.col("fold").cast("int").alias("fold")).agg(F.count("*").alias("n"))


@query("SELECT CAST(0 AS BIGINT) AS leaks")
def split_leak_check(spark, sf_dir):
    return splits.leaks(*_split(spark, sf_dir)).agg(F.count("*").alias("leaks"))


@query()
def split_summary(spark, sf_dir):
    a, t, _ = _split(spark, sf_dir)
    return rounded(splits.fold_summary(a, t))


@query()
def easy_negative_weights(spark, sf_dir):
    given = pairs(spark, sf_dir).withColumns({"combo_rank": F.col("target") % 9, "ret_rank": F.col("target") % 7, "name_tset": F.col("p"), "addr_tset": F.lit(None).cast("double")})
    return splits.thin_negatives(given, 0.25, F.concat_ws("-", "anchor", "target")).groupBy("label", "weight").agg(F.count("*").alias("n"))


EXACT = f"""WITH {DOC_RECORDS}, x AS (SELECT *, trim(regexp_replace(replace(lower(business_name), 'ß', 'ss'), '\\s+', ' ', 'g')) AS n, trim(regexp_replace(replace(lower(business_address), 'ß', 'ss'), '\\s+', ' ', 'g')) AS a FROM doc_records)"""


@query(f"{EXACT} SELECT entity_id, count(*) OVER (PARTITION BY country, n, a) AS copies FROM x WHERE length(n) >= 5 AND length(a) >= 12 QUALIFY count(*) OVER (PARTITION BY country, n, a) > 1")
def exact_duplicates(spark, sf_dir):
    return duplicates.exact_groups(doc_records(spark, sf_dir)).select("entity_id", "copies")


@query(f"""{EXACT}, g AS (SELECT CAST(src AS BIGINT) * 2000000000 + id AS code, country, n, a FROM x WHERE length(n) >= 5 AND length(a) >= 12 AND src <> 1), m AS (SELECT code // 7 AS anchor, code, (code % 100) / 100 AS p FROM g)
SELECT anchor, code, round(max(p), 6) AS p FROM (SELECT anchor, code, p FROM m UNION ALL SELECT m.anchor, o.code, m.p FROM m JOIN g s ON s.code = m.code JOIN g o ON o.country = s.country AND o.n = s.n AND o.a = s.a) GROUP BY ALL""")
def duplicate_expansion(spark, sf_dir):
    r = records.with_codes(doc_records(spark, sf_dir)).filter("source <> 1")
    groups = duplicates.exact_groups(r)
    long = r.withColumn("n", duplicates.exact_text("business_name")).withColumn("a", duplicates.exact_text("business_address")).filter("length(n) >= 5 and length(a) >= 12")
    matches = long.select(F.floor(F.col("code") / 7).alias("anchor"), "code", ((F.col("code") % 100) / 100).alias("p"))
    return rounded(duplicates.expand_matches(matches, groups))


@query(f"WITH {PAIR_VIEW}, {OWNER} SELECT concat('S1-', a.anchor) AS source1_entity_id, coalesce(string_agg('S2-' || o.target, ',' ORDER BY 'S2-' || o.target), '') AS matched_entity_ids FROM anchors a LEFT JOIN owned o ON o.anchor = a.anchor AND o.keep GROUP BY a.anchor")
def id_lists(spark, sf_dir):
    from matchloom.sources import tsv

    scored = _owned(spark, sf_dir)
    named = scored.filter("keep").select(F.concat(F.lit("S1-"), "anchor").alias("source1_entity_id"), F.concat(F.lit("S2-"), "target").alias("target_entity_id"))
    ids = anchors(spark, sf_dir, scored).select(F.concat(F.lit("S1-"), "anchor").alias("source1_entity_id"))
    return tsv.id_lists(ids, named, "matched_entity_ids")


# ---------------------------------------------------------------- learning and streams


@query()
def gbt_match(spark, sf_dir):
    from matchloom.plans import learning

    scored = compete.competition(pairs(spark, sf_dir)).withColumnRenamed("p", "score0")
    names = ("score0", "q", "tax", "a_gap", "t_margin")
    return rounded(learning.fit(scored, names).predict(scored).select("anchor", "target", "p"), 4)


@query(f"WITH {PAIR_VIEW}, {CLAIMS} SELECT anchor, target, round(p, 4) AS p, round(t_best_other, 4) AS t_best_other, CAST(a_rank AS INT) AS a_rank FROM comp WHERE p >= 0.005")
def stage2_gate(spark, sf_dir):
    from matchloom.plans import learning

    given = pairs(spark, sf_dir).withColumns({c: F.lit(0.0) for c in learning.CARRIED})
    out = learning.stage2_table(given)
    return out.select("anchor", "target", *(F.round(F.col(c).cast("double"), 4).alias(c) for c in ("p", "t_best_other")), F.col("a_rank").cast("int").alias("a_rank"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    from matchloom.streaming.incremental import event_counts

    out = event_counts(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))

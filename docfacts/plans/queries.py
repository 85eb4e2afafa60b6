"""The registered queries over the driver's tables, and their SQL.

The tables have no gazetteers, italics or answers, so each query derives what it
needs from whole tables, on both sides in the same way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.functions import text as T
from docfacts.operators import locations, places, qa, species, taxa, vernacular

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. In local mode `documents`, there a single small file, is dealt out to the threads; on a cluster its parts are read as they lie."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sc = spark.sparkContext
    return df.repartition(sc.defaultParallelism) if name == "documents" and sc.master.startswith("local[") else df


# pieces of SQL


def sql_spans(text: str, pattern: str) -> str:
    """list of {m, s, e} of all matches."""
    m, g = f"regexp_extract_all({text}, {pattern})", f"string_split_regex({text}, {pattern})"
    before = f"list_sum(list_transform({g}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform({m}[1:i - 1], lambda x: length(x))), 0)"
    return f"list_transform(range(1, len({m}) + 1), lambda i: {{'m': {m}[i], 's': cast({before} as int), 'e': cast({before} + length({m}[i]) as int)}})"


def sql_rows(source: str, keys: str, text: str, pattern: str) -> str:
    """Rows (keys, i, m, s, e) of all matches; offsets are running sums, so long texts stay cheap."""
    return f"""(select {keys}, i, m, (sum(length(m) + length(g)) over w - length(m))::int as s, (sum(length(m) + length(g)) over w)::int as e from
      (select {keys}, unnest(m) as m, unnest(g[:len(m)]) as g, unnest(range(1, len(m) + 1)) as i from (select {keys}, regexp_extract_all({text}, {pattern}) as m, string_split_regex({text}, {pattern}) as g from {source}))
      window w as (partition by {keys} order by i))"""


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_taxon(c: str) -> str:
    # all tails at once: the longest end of the name that is nothing but tails
    tails = "|".join(p.replace("(?Ui)", "(?i)").replace("(?U)", "").removesuffix("$") for p in (*T.AUTHORSHIP[:3], "(?i:" + T.AUTHORSHIP[3].replace("(?Ui)", "").removesuffix("$") + ")"))
    s = f"regexp_replace(strip_accents({c}), {quoted('(?:' + tails + ')+$')}, '')"
    s = f"regexp_replace(lower(trim({s})), {quoted(T.RANK_TAGS.replace('(?Ui)', '(?i)'))}, ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({s}, '[^a-z0-9\\s.]', ' ', 'g'), '\\s+', ' ', 'g'))"


def sql_place(c: str, keep: str = "") -> str:
    return f"trim(regexp_replace(regexp_replace(lower(strip_accents({c})), '[^a-z0-9\\s{keep}]', ' ', 'g'), '\\s+', ' ', 'g'))"


def sql_head(c: str) -> str:
    """struct {core, hint}."""
    whens = " ".join(f"when regexp_matches({c}, {quoted(p)}) and trim(regexp_replace({c}, {quoted(p)}, '')) <> '' then {{'core': trim(regexp_replace({c}, {quoted(p)}, '')), 'hint': '{h}'}}" for p, h in T.head_patterns())
    return f"case {whens} else {{'core': {c}, 'hint': null::varchar}} end"


ASCII = "replace(strip_accents(text), 'ß', 'ss')"
BINOMIAL_SQL = "'\\b(?:[A-Z][a-z]{2,})\\s+(?:[a-z]{3,})\\b'"


def ascii_text(c: str = "text") -> Column:
    return F.replace(T.fold_accents(F.col(c)), F.lit("ß"), F.lit("ss"))


# species


@query(f"""
with t as (select doc_id, {ASCII} as text from documents), s as (select doc_id, unnest({sql_spans("text", BINOMIAL_SQL)}) as x from t)
select doc_id, count(*) as n_spans, count(distinct lower(x.m)) as n_names, min(x.s) as first_start, cast(sum(x.e) as bigint) as sum_end from s group by doc_id
""")
def binomial_scan(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.explode(T.spans(ascii_text(), T.BINOMIAL)).alias("x"))
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_spans"), F.count_distinct(F.lower("x.text")).alias("n_names"), F.min("x.start").alias("first_start"), F.sum("x.end").alias("sum_end"))


_NAME = "upper(substr(p_name, 1, 1)) || substr(p_name, 2)"
_RAW = f"{_NAME} || ' (' || p_brand || ') Mill. & van Hoek, ' || (1700 + p_size)"


@query(f"""
select raw, {sql_taxon("raw")} as taxon, {sql_place("raw")} as place, {sql_place("raw", "-")} as common, substr(replace({sql_taxon("raw")}, ' ', ''), 1, 3) as prefix3, count(*) as n
from (select {_RAW} || ' née-' || lower(p_type) as raw from part union all select {_RAW} from part union all select n_name || ' ssp. ' || lower(r_name) from nation join region on n_regionkey = r_regionkey) group by raw
""")
def normalize_names(spark, sf):
    read(spark, sf, "part").createOrReplaceTempView("_part")
    a = spark.table("_part").select(F.expr(_RAW).alias("raw"), F.lower("p_type").alias("t"))
    n = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat("n_name", F.lit(" ssp. "), F.lower("r_name")).alias("raw"))
    rows = a.select(F.concat("raw", F.lit(" née-"), "t").alias("raw")).union(a.select("raw")).union(n).groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    raw = F.col("raw")
    return rows.select("raw", T.normalize_taxon(raw).alias("taxon"), T.normalize_place(raw).alias("place"), T.normalize_vernacular(raw).alias("common"), T.prefix3(T.normalize_taxon(raw)).alias("prefix3"), "n")


def part_taxa(spark, sf) -> taxa.Taxa:
    """A gazetteer of part names: the words turned round are a synonym; kinds are genera, types are kingdoms."""
    p = read(spark, sf, "part")
    c = p.groupBy("p_name").agg(F.min("p_partkey").alias("k"), F.min_by("p_type", "p_partkey").alias("t"))
    words = F.split("p_name", " ")
    sp = c.select(F.col("k").cast("string").alias("id"), F.initcap(F.substring_index("p_name", " ", 1)).alias("a"), F.col("p_name"), F.lit("species").alias("rank"), F.array(F.concat(F.lit("g-"), F.element_at(words, -1), F.lit("-"), F.col("t"))).alias("parents"), F.array(F.concat_ws(" ", F.element_at(words, -1), F.element_at(words, 1))).alias("synonyms"), F.col("k").alias("ord"))
    sp = sp.select("id", F.expr("concat(upper(substr(p_name, 1, 1)), substr(p_name, 2))").alias("term"), "rank", "parents", "synonyms", "ord")
    none = F.array().cast("array<string>")
    g = c.select(F.element_at(words, -1).alias("w"), "t").distinct().select(F.concat(F.lit("g-"), "w", F.lit("-"), "t").alias("id"), F.col("w").alias("term"), F.lit("genus").alias("rank"), F.array(F.concat(F.lit("k-"), "t")).alias("parents"), none.alias("synonyms"), F.lit(10**12).alias("ord"))
    k = c.select("t").distinct().select(F.concat(F.lit("k-"), "t").alias("id"), F.col("t").alias("term"), F.lit("kingdom").alias("rank"), none.alias("parents"), none.alias("synonyms"), F.lit(10**13).alias("ord"))
    return taxa.build_taxa(sp.unionByName(g).unionByName(k))


_GAZ = f"""
c as (select p_name, min(p_partkey) as k, arg_min(p_type, p_partkey) as t from part group by p_name),
concepts as (select k::varchar as ott_id, upper(substr(p_name, 1, 1)) || substr(p_name, 2) as pref, 'species' as rank, t as kingdom from c
  union all select distinct 'g-' || split_part(p_name, ' ', 2) || '-' || t, split_part(p_name, ' ', 2), 'genus', t from c union all select distinct 'k-' || t, t, 'kingdom', t from c),
names as (select {sql_taxon("pref")} as name_norm, ott_id, 0 as is_syn, case rank when 'species' then ott_id::bigint when 'genus' then 1000000000000 else 10000000000000 end as ord from concepts
  union all select split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1), k::varchar, 1, k from c)"""
#: One mention of each part: as it is, turned round, abbreviated, or a word that is no name.
_MENTION = f"""case when p_size <= 15 then {_RAW} when p_size <= 30 then split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)
  when p_size <= 40 then upper(substr(p_name, 1, 1)) || '. ' || split_part(p_name, ' ', 2) else lower(p_type) || ' thing' end"""


def part_mentions(spark, sf) -> DataFrame:
    read(spark, sf, "part").createOrReplaceTempView("_part")
    return spark.sql(f"select p_partkey, {_MENTION} as raw from _part")


_EXACT = "e as (select name_norm, arg_min({'o': ott_id, 's': is_syn}, is_syn * 100000000000000 + ord) as x from names where name_norm <> '' group by name_norm)"
_ABBREV = """a as (select q.name_norm, min(n.ott_id) as ott_id from q join names n on n.name_norm like q.i || '% ' || q.ep where q.i <> '' and not exists (select 1 from e where e.name_norm = q.name_norm)
  group by q.name_norm having count(distinct n.ott_id) = 1)"""
_Q = f"""q as (select distinct n as name_norm, regexp_extract(n, '^([a-z])\\.?\\s+([a-z][a-z-]+)$', 1) as i, regexp_extract(n, '^([a-z])\\.?\\s+([a-z][a-z-]+)$', 2) as ep from (select {sql_taxon("raw")} as n from m))"""


@query(f"""
with {_GAZ}, {_EXACT}, m as (select p_partkey, {_MENTION} as raw from part)
select p_partkey, 'ott:' || x.o as ott_id, pref as canonical, rank, kingdom, case x.s when 1 then 'synonym' else 'exact' end as match_type from m join e on e.name_norm = {sql_taxon("raw")} join concepts on ott_id = x.o
""")
def resolve_exact(spark, sf):
    m = part_mentions(spark, sf)
    keys = taxa.keys_of(m, "raw")
    hits = taxa.exact(keys.select("name_norm").distinct(), part_taxa(spark, sf))
    return m.join(keys.join(hits, "name_norm"), "raw").select("p_partkey", "hit.ott_id", "hit.canonical", "hit.rank", "hit.kingdom", "hit.match_type")


@query(f"""
with {_GAZ}, {_EXACT}, m as (select distinct substr(p_name, 1, 1) || '. ' || split_part(p_name, ' ', 2) as raw from part), {_Q}, {_ABBREV}
select a.name_norm, 'ott:' || a.ott_id as ott_id, pref as canonical from a join concepts using (ott_id)
""")
def resolve_abbrev(spark, sf):
    q = read(spark, sf, "part").select(F.concat(F.substring("p_name", 1, 1), F.lit(". "), F.element_at(F.split("p_name", " "), 2)).alias("raw"))
    q = taxa.keys_of(q, "raw").select("name_norm").distinct()
    gaz = part_taxa(spark, sf)
    known = taxa.exact(q, gaz)
    return taxa.abbreviated(q.join(known, "name_norm", "left_anti"), gaz).select("name_norm", "hit.ott_id", "hit.canonical")


@query(f"""
with {_GAZ}, {_EXACT}, m as (select p_partkey, {_MENTION} as raw from part), {_Q}, {_ABBREV},
r as (select p_partkey, case when x.o is not null then case x.s when 1 then 'synonym' else 'exact' end when a.ott_id is not null then 'abbrev' else 'none' end as match_type, coalesce(x.o, a.ott_id) as o
  from m left join e on e.name_norm = {sql_taxon("raw")} left join a on a.name_norm = {sql_taxon("raw")})
select match_type, count(*) as n, count(distinct o) as n_taxa, cast(sum(p_partkey) as bigint) as keys from r group by match_type
""")
def cascade_first_hit(spark, sf):
    r = taxa.resolve_taxa(part_mentions(spark, sf), "raw", part_taxa(spark, sf), with_fuzzy=False)
    return r.groupBy(F.coalesce("hit.match_type", F.lit("none")).alias("match_type")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("hit.ott_id").alias("n_taxa"), F.sum("p_partkey").alias("keys"))


def typos(spark, sf) -> DataFrame:
    """Part names without their second letter from the end."""
    return read(spark, sf, "part").select(F.expr("concat(substr(p_name, 1, length(p_name) - 2), substr(p_name, length(p_name), 1))").alias("name_norm")).distinct()


@query(f"""
with {_GAZ}, q as (select distinct substr(p_name, 1, length(p_name) - 2) || substr(p_name, length(p_name), 1) as name_norm from part),
b as (select *, substr(replace(name_norm, ' ', ''), 1, 3) as prefix3, row_number() over (partition by substr(replace(name_norm, ' ', ''), 1, 3) order by ord, is_syn, ott_id) as k from names)
select q.name_norm, b.name_norm as cand, count(*) as n from q join b on b.prefix3 = substr(replace(q.name_norm, ' ', ''), 1, 3)
where length(q.name_norm) >= 8 and levenshtein(q.name_norm, b.name_norm) <= floor(0.1 * (length(q.name_norm) + length(b.name_norm)) + 1e-9) group by all
""")
def fuzzy_block(spark, sf):
    c = taxa.fuzzy_candidates(typos(spark, sf), part_taxa(spark, sf).names)
    return c.groupBy("name_norm", "cand").agg(F.count(F.lit(1)).alias("n"))


@query()
def resolve_fuzzy(spark, sf):
    return taxa.fuzzy(typos(spark, sf), part_taxa(spark, sf)).select("name_norm", "hit.ott_id", "hit.canonical", "hit.score")


@query("""
with recursive c as (select 'c' || c_custkey as id, c_name as pref, 'species' as rank, 'n' || c_nationkey as parent from customer union all select 's' || s_suppkey, s_name, 'species', 'n' || s_nationkey from supplier
  union all select 'n' || n_nationkey, n_name, 'genus', 'r' || n_regionkey from nation union all select 'r' || r_regionkey, r_name, 'Kingdom', null from region),
u as (select id, id as at, 0 as step from c union all select u.id, c.parent, step + 1 from u join c on c.id = u.at where c.parent is not null and lower(c.rank) <> 'kingdom' and step < 40)
select u.id as ott_id, c.pref as kingdom from u join c on c.id = u.at where lower(c.rank) = 'kingdom'
""")
def kingdom_climb(spark, sf):
    def level(name, letter, key, label, rank, parent):
        return read(spark, sf, name).select(F.concat(F.lit(letter), F.col(key)).alias("ott_id"), F.col(label).alias("pref"), F.lit(rank).alias("rank"), parent.cast("string").alias("parent"))

    c = level("customer", "c", "c_custkey", "c_name", "species", F.concat(F.lit("n"), "c_nationkey")).union(level("supplier", "s", "s_suppkey", "s_name", "species", F.concat(F.lit("n"), "s_nationkey")))
    c = c.union(level("nation", "n", "n_nationkey", "n_name", "genus", F.concat(F.lit("r"), "n_regionkey"))).union(level("region", "r", "r_regionkey", "r_name", "Kingdom", F.lit(None)))
    return taxa.kingdoms(c)


# places

_PLACES = """
raw as (select 'n' || n_nationkey as geonameid, 'Nation ' || n_nationkey as name, 'A' as fclass, 'ADM2' as fcode, n_regionkey::varchar as admin1, n_nationkey::varchar as admin2, 0 as population from nation
  union all select 'r' || r_regionkey, r_name, 'A', 'ADM1', r_regionkey::varchar, '', 0 from region
  union all select 's' || s_suppkey, 'Nation ' || s_nationkey, 'P', 'PPL', n_regionkey::varchar, n_nationkey::varchar, floor(abs(s_acctbal))::bigint from supplier join nation on s_nationkey = n_nationkey
  union all select 'c' || c_custkey, 'Nation ' || c_nationkey, case c_mktsegment when 'BUILDING' then 'S' when 'MACHINERY' then 'T' else 'H' end, case c_mktsegment when 'BUILDING' then 'HTL' when 'MACHINERY' then 'MTS' else 'STM' end,
    n_regionkey::varchar, n_nationkey::varchar, 0 from customer join nation on c_nationkey = n_nationkey)"""


def raw_places(spark, sf) -> DataFrame:
    for t in ("nation", "region", "supplier", "customer"):
        read(spark, sf, t).createOrReplaceTempView(f"_{t}")
    return spark.sql("""
      select concat('n', n_nationkey) as geonameid, concat('Nation ', n_nationkey) as name, 'A' as fclass, 'ADM2' as fcode, string(n_regionkey) as admin1, string(n_nationkey) as admin2, '0' as population from _nation
      union all select concat('r', r_regionkey), r_name, 'A', 'ADM1', string(r_regionkey), '', '' from _region
      union all select concat('s', s_suppkey), concat('Nation ', s_nationkey), 'P', 'PPL', string(n_regionkey), string(n_nationkey), string(floor(abs(s_acctbal))) from _supplier join _nation on s_nationkey = n_nationkey
      union all select concat('c', c_custkey), concat('Nation ', c_nationkey), case c_mktsegment when 'BUILDING' then 'S' when 'MACHINERY' then 'T' else 'H' end, case c_mktsegment when 'BUILDING' then 'HTL' when 'MACHINERY' then 'MTS' else 'STM' end,
        string(n_regionkey), string(n_nationkey), 'x' from _customer join _nation on c_nationkey = n_nationkey""").withColumns({"asciiname": F.col("name"), "alternates": F.concat(F.lit("Tierra "), "admin2"), "ord": F.col("geonameid")})


@query(f"""
with {_PLACES}, a1 as (select admin1, max(name) as region from raw where fcode = 'ADM1' group by admin1), a2 as (select admin1, admin2, max(name) as province from raw where fcode = 'ADM2' group by admin1, admin2)
select fclass, fcode, a2.province, a1.region, count(*) as n, cast(sum(population) as bigint) as people from raw left join a1 using (admin1) left join a2 using (admin1, admin2) where fclass <> 'S' group by all
""")
def admin_context(spark, sf):
    p = places.build_places(raw_places(spark, sf)).places
    return p.groupBy("fclass", "fcode", "province", "region").agg(F.count(F.lit(1)).alias("n"), F.sum("population").alias("people"))


_HEADED = ("", "río ", "Provincia de ", "Sierra de la ", "termino municipal de ", "Parque Natural de ", "Hotel ")


@query(f"""
with {_PLACES}, q as (select h || 'Nation ' || n_nationkey as raw from nation, (values {", ".join(f"({quoted(h)})" for h in _HEADED)}) v(h) union all select 'Oeste' union all select r_name from region),
k as (select raw, {sql_place("raw")} as key from q), h as (select raw, key, {sql_head("key")} as h from k where key <> 'oeste'),
p as (select *, {sql_place("name")} as norm, case fclass when 'P' then 5 when 'A' then 4 when 'T' then 3 when 'H' then 3 when 'L' then 2 else 1 end as pri from raw where fclass <> 'S'),
e as (select raw, arg_min(geonameid, {{'a': -pri, 'b': -population, 'c': geonameid}}) as g, 'exact' as match_type from h join p on p.norm = h.key group by raw),
c as (select raw, arg_min(geonameid, {{'z': case when contains(h.h.hint, 'A') and fcode = 'ADM2' then 0 else 1 end, 'a': -pri, 'b': -population, 'c': geonameid}}) as g, 'core' as match_type
  from h join p on p.norm = h.h.core and contains(h.h.hint, p.fclass) where h.h.core <> h.key and raw not in (select raw from e) group by raw),
r as (select * from e union all select * from c)
select q.raw, 'geonames:' || g as geonameid, p.name as canonical, match_type, case p.fcode when 'ADM1' then 'region' when 'ADM2' then 'province' when 'STM' then 'river' when 'MTS' then 'relief' when 'PPL' then 'municipality' end as type
from q left join r using (raw) left join p on p.geonameid = r.g
""")
def place_rank(spark, sf):
    q = read(spark, sf, "nation").select(F.explode(F.array(*map(F.lit, _HEADED))).alias("h"), "n_nationkey").select(F.concat("h", F.lit("Nation "), "n_nationkey").alias("raw"))
    q = q.union(spark.range(1).select(F.lit("Oeste"))).union(read(spark, sf, "region").select("r_name"))
    r = places.resolve_places(q, "raw", places.build_places(raw_places(spark, sf)))
    return r.select("raw", "hit.geonameid", "hit.canonical", "hit.match_type", "hit.type")


_GENERIC = ("rio", "rios", "arroyo de la", "provincia de", "sierra de los", "parque natural del", "comunidades autonomas de", "reserva de la biosfera", "monte", "punta de el", "casa de", "parque de", "termino municipal")


@query(f"""
select raw, h.core as core, h.hint as hint, n from (select raw, {sql_head("raw")} as h, n from
(select g || ' ' || {sql_place("n_name")} as raw, count(*) as n from nation, (values {", ".join(f"({quoted(g)})" for g in _GENERIC)}) v(g) group by 1))
""")
def strip_head(spark, sf):
    q = read(spark, sf, "nation").select(F.explode(F.array(*map(F.lit, _GENERIC))).alias("g"), "n_name").select(F.concat("g", F.lit(" "), T.normalize_place(F.col("n_name"))).alias("raw")).groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    return q.select("raw", T.strip_head(F.col("raw")).alias("h"), "n").select("raw", "h.core", "h.hint", "n")


_CODES = sorted({c for v in T.CODE_TYPES.values() for c in v.split()} | {"PPL", "XXX"})
_TYPE_CASE = " ".join(f"when fcode in ({', '.join(quoted(c) for c in v.split())}) then '{t}'" for t, v in T.CODE_TYPES.items()) + " " + " ".join(f"when fclass = '{k}' then '{t}'" for k, t in T.CLASS_TYPES.items())


@query(f"""
with x as (select fclass, fcode from (values {", ".join(f"('{c}')" for c in "AHLPRTV")}) a(fclass), (values {", ".join(f"('{c}')" for c in _CODES)}) b(fcode))
select fclass, fcode, case {_TYPE_CASE} else 'place' end as type, {sql_place("n_name")} as name from x, nation
""")
def type_of(spark, sf):
    n = read(spark, sf, "nation").select(T.normalize_place(F.col("n_name")).alias("name"))
    x = n.select("name", F.explode(F.array(*map(F.lit, "AHLPRTV"))).alias("fclass")).select("*", F.explode(F.array(*map(F.lit, _CODES))).alias("fcode"))
    return x.select("fclass", "fcode", T.place_type(F.col("fclass"), F.col("fcode")).alias("type"), "name")


# spans and sections

_TERMS = ("The", "de la", "ung.", "tion")


@query(f"""
with t as (select doc_id, term, string_split(lower(text), lower(term)) as g, length(term) as k from documents, (values {", ".join(f"({quoted(x)})" for x in _TERMS)}) v(term)),
s as (select doc_id, term, k, unnest(list_transform(range(1, least(len(g) - 1, 25) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x))) + (i - 1) * k)) as s from t)
select doc_id, term, count(*) as n, cast(min(s) as int) as first_start, cast(max(s) + max(k) as int) as last_end, cast(sum(s) as bigint) as sum_start from s group by doc_id, term
""")
def find_spans(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "text", F.explode(F.array(*map(F.lit, _TERMS))).alias("term"))
    s = d.select("doc_id", "term", F.explode(T.find_spans(F.col("text"), F.col("term"))).alias("s"))
    return s.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"), F.min("s.start").alias("first_start"), F.max("s.end").alias("last_end"), F.sum("s.start").alias("sum_start"))


@query(f"""
with r as (select doc_id, text, unnest({sql_spans("text", "' (?:the|der|que|les) '")}) as x from documents),
i as (select doc_id, x.e as a, least(case when strpos(substr(text, x.e + 1), chr(10)) > 0 then x.e + strpos(substr(text, x.e + 1), chr(10)) - 1 else length(text) end, x.e + 200) as b from r),
o as (select *, max(b) over (partition by doc_id order by a, b rows between unbounded preceding and 1 preceding) as m from i where b > a),
g as (select *, sum(case when m is null or a > m then 1 else 0 end) over (partition by doc_id order by a, b rows unbounded preceding) as k from o),
w as (select doc_id, k, min(a) as a, max(b) as b from g group by doc_id, k)
select doc_id, count(*) as n_sections, cast(min(a) as int) as first_start, cast(sum(b - a) as bigint) as n_chars from w group by doc_id
""")
def merge_sections(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.explode(locations.section_windows(F.col("text"), " (?:the|der|que|les) ", "\n", 200)).alias("w"))
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sections"), F.min("w.start").alias("first_start"), F.sum(F.col("w.end") - F.col("w.start")).alias("n_chars"))


_WORDS = "'[0-9A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+'"


def common_names(spark, sf) -> DataFrame:
    """A gazetteer from benchmark passages: words two and three, words four to six, and word seven of each."""
    b = read(spark, sf, "benchmark").select(F.transform(F.regexp_extract_all("text", F.lit(T.WORD), F.lit(0)), lambda x: F.lower(T.fold_accents(x))).alias("w")).where("size(w) >= 7")
    keys = b.select(F.explode(F.array(*(F.array_join(F.slice("w", a, k), " ") for a, k in ((2, 2), (4, 3), (7, 1))))).alias("common_norm")).distinct()
    return keys.select("common_norm", F.array(F.initcap(F.substring_index("common_norm", " ", 1))).alias("scientific"))


@query(f"""
with recursive b as (select list_transform(regexp_extract_all(text, {_WORDS}), lambda x: lower(strip_accents(x))) as w from benchmark),
keys as (select distinct array_to_string(w[2:3], ' ') as key, 2 as k from b where len(w) >= 7 union select array_to_string(w[4:6], ' '), 3 from b where len(w) >= 7 union select w[7], 1 from b where len(w) >= 7),
t as (select *, lower(strip_accents(m)) as n from {sql_rows("documents", "doc_id", "text", _WORDS)}),
g as (select *, n || ' ' || lead(n) over w as n2, n || ' ' || lead(n) over w || ' ' || lead(n, 2) over w as n3, lead(e) over w as e2, lead(e, 2) over w as e3 from t window w as (partition by doc_id order by i)),
l as (select doc_id, i, m as head, s, case when c.key is not null then 3 when b2.key is not null then 2 else 1 end as k, case when c.key is not null then e3 when b2.key is not null then e2 else e end as e
  from g left join (select key from keys where k = 1) a on a.key = n left join (select key from keys where k = 2) b2 on b2.key = n2 left join (select key from keys where k = 3) c on c.key = n3 where coalesce(a.key, b2.key, c.key) is not null),
m as (select * from l where not (upper(substr(head, 1, 1)) = substr(head, 1, 1) and lower(substr(head, 1, 1)) <> substr(head, 1, 1))),
n as (select a.doc_id, a.i, a.k, a.s, a.e, b.i as nxt from m a asof left join m b on b.doc_id = a.doc_id and a.i + a.k <= b.i),
r as (select n.* from n join (select doc_id, min(i) as i from n group by doc_id) f using (doc_id, i) union all select n.* from r join n on n.doc_id = r.doc_id and n.i = r.nxt)
select doc_id, s as start, e as "end", e - s as n_chars from r
""")
def vernacular_scan(spark, sf):
    v = vernacular.scan_vernacular(read(spark, sf, "documents"), common_names(spark, sf), "doc_id")
    return v.select("doc_id", "start", "end", F.length("common").alias("n_chars"))


# reports

_BENCH = f"""
bn as (select lower(x.m) as low, min(x.m) as raw, min(item_id) as item from (select item_id, unnest({sql_spans("text", BINOMIAL_SQL)}) as x from (select item_id, {ASCII} as text from benchmark)) group by 1),
nm as (select item, raw, {sql_taxon("raw")} as norm from bn),
gz as (select norm, arg_min(raw, {{'i': item, 'r': raw}}) as pref, arg_min(item || ':' || raw, {{'i': item, 'r': raw}}) as id from nm where norm <> '' group by norm)"""
_FOUND = f"""
{_BENCH},
dc as (select doc_id, lower(x.m) as low, arg_min(x.m, x.s) as raw, min(x.s) as s from (select doc_id, unnest({sql_spans("text", BINOMIAL_SQL)}) as x from (select doc_id, {ASCII} as text from documents)) group by 1, 2),
fd as (select doc_id, raw, s, id, pref, case length(pref) % 3 when 0 then 'family' when 1 then 'genus' else 'species' end as rank from (select doc_id, raw, s, {sql_taxon("raw")} as norm from dc) join gz using (norm)),
ok as (select * from fd where rank <> 'family')"""


def benchmark_taxa(spark, sf) -> taxa.Taxa:
    """The binomials of benchmark passages as taxa; ranks by their length."""
    b = read(spark, sf, "benchmark").select("item_id", F.explode(T.spans(ascii_text(), T.BINOMIAL)).alias("x"))
    b = b.groupBy(F.lower("x.text")).agg(F.min("x.text").alias("raw"), F.min("item_id").alias("item"))
    b = b.withColumn("norm", T.normalize_taxon(F.col("raw"))).where("norm <> ''").groupBy("norm").agg(F.min(F.struct("item", "raw")).alias("y"))
    n = F.length("y.raw") % 3
    return taxa.build_taxa(b.select(F.concat("y.item", F.lit(":"), "y.raw").alias("id"), F.col("y.raw").alias("term"), F.when(n == 0, "family").when(n == 1, "genus").otherwise("species").alias("rank"), F.array().cast("array<string>").alias("parents"), F.array().cast("array<string>").alias("synonyms"), F.col("y.item").alias("ord")))


def ascii_documents(spark, sf) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", ascii_text().alias("text"), F.array().cast("array<string>").alias("italicized_terms"))


@query(f"""with {_FOUND} select doc_id, 'ott:' || id as ott_id, any_value(pref) as canonical, any_value(rank) as rank, count(*)::int as count, min(s) as first_start from ok group by doc_id, id""")
def species_report(spark, sf):
    f = species.findings(species.mentions(ascii_documents(spark, sf), benchmark_taxa(spark, sf), id_col="doc_id"))
    return f.select(F.col("id").alias("doc_id"), "ott_id", "canonical", "rank", "count", F.get("mentions", F.lit(0))["start"].alias("first_start"))


@query(f"""
with {_FOUND}, p as (select l.quality = 1 as gold, d.doc_id is not null as pred from labels l left join (select distinct doc_id from ok) d using (doc_id))
select count(*) as n, count(*) filter (gold and pred) as tp, count(*) filter (not gold and pred) as fp, count(*) filter (gold and not pred) as fn, count(*) filter (not gold and not pred) as tn from p
""")
def presence_pr(spark, sf):
    e = species.extract_species(ascii_documents(spark, sf), benchmark_taxa(spark, sf), id_col="doc_id").select("doc_id", (F.col("n_species") > 0).alias("pred"))
    p = read(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("gold")).join(e, "doc_id", "left")
    g, y = F.col("gold"), F.coalesce("pred", F.lit(False))
    return p.agg(F.count(F.lit(1)).alias("n"), F.count_if(g & y).alias("tp"), F.count_if(~g & y).alias("fp"), F.count_if(g & ~y).alias("fn"), F.count_if(~g & ~y).alias("tn"))


_CAP = "'\\b\\p{Lu}[\\p{L}''’-]+(?:\\s+(?:(?:de|del|la|las|los|el|y)\\s+)*\\p{Lu}[\\p{L}''’-]+)*'"
_ONE, _LEAD = _CAP.replace("|y)", ")"), locations.LEAD.removeprefix("(?U)").replace("ú", "u")
_ADMIN_SQL = "[" + ", ".join(quoted(w) for w in locations.ADMIN) + "]"
_HINT_CASE = " ".join(f"when list_has_any(string_split(norm, ' '), [{', '.join(quoted(h) for h in v.split())}]) then '{t}'" for t, v in T.TYPE_HINTS)


@query(f"""
with bx as (select item_id, unnest(regexp_extract_all({ASCII}, {_CAP})) as name from benchmark), gp as (select {sql_place("name")} as gnorm, arg_min(name, {{'i': item_id, 'n': name}}) as name, min(item_id) as item from bx group by 1 having length({sql_place("name")}) >= 2),
x as (select doc_id, unnest({sql_spans("text", _CAP)}) as x from (select doc_id, {ASCII} as text from documents)),
m as (select doc_id, trim(x.m) as raw, x.s as s, x.e as e, regexp_replace(trim(lower(strip_accents(x.m))), '\\s+', ' ', 'g') as norm, {sql_place("x.m")} as key from x),
v as (select m.*, not exists (select 1 from gp where gp.gnorm = m.key) and regexp_matches(raw, '\\sy\\s|{_LEAD}') as apart from m),
q as (select doc_id, raw, s, norm, key from v where not apart union all select doc_id, n, s + p.s + length(p.m) - length(n), regexp_replace(trim(lower(strip_accents(n))), '\\s+', ' ', 'g'), {sql_place("n")}
  from (select doc_id, s, p, regexp_replace(p.m, '{_LEAD}', '') as n from (select doc_id, s, unnest({sql_spans("raw", _ONE)}) as p from v where apart))),
f as (select * from q where not regexp_matches(norm, '^[\\W\\d]+$') and length(norm) > 2 and not list_has_any(string_split(norm, ' '), {_ADMIN_SQL})),
r as (select doc_id, raw, s, norm, gp.gnorm is not null as verified, gp.name as canonical, case {_HINT_CASE} else 'place' end as kind from f left join gp on gp.gnorm = f.key and not (strpos(f.key, ' ') = 0 and f.key in ({", ".join(quoted(w) for w in places.COMMON)})))
select doc_id, case when verified then canonical else 'raw:' || norm end as key, bool_or(verified) as verified, count(*)::int as count, min(s) as first_start, case when bool_or(verified) then 'municipality' else min(kind) end as type from r group by 1, 2
""")
def location_report(spark, sf):
    b = read(spark, sf, "benchmark").select("item_id", F.explode(T.spans(ascii_text(), locations.CAPITALISED)).alias("x")).select("item_id", "x.text")
    b = b.groupBy(T.normalize_place(F.col("text")).alias("norm")).agg(F.min(F.struct("item_id", "text")).alias("y"))
    raw = b.select(F.concat("y.item_id", F.lit("-"), "norm").alias("geonameid"), F.col("y.text").alias("name"), F.col("y.text").alias("asciiname"), F.lit("").alias("alternates"), F.lit("P").alias("fclass"), F.lit("PPL").alias("fcode"), F.lit("").alias("admin1"), F.lit("").alias("admin2"), F.lit("0").alias("population"), F.col("y.item_id").alias("ord"))
    f = locations.location_findings(locations.location_mentions(ascii_documents(spark, sf), places.build_places(raw), id_col="doc_id"))
    return f.select(F.col("id").alias("doc_id"), F.when(F.col("verified"), F.col("name")).otherwise(F.regexp_replace("key", r"\s+", " ")).alias("key"), "verified", "count", F.get("mentions", F.lit(0))["start"].alias("first_start"), "type")


@query("""select lang, count(*) as n, cast(sum(doc_id) as bigint) as ids from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id) group by lang""")
def resume_anti_join(spark, sf):
    todo = read(spark, sf, "documents").join(read(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")
    return todo.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query(f"""
with p as (select sci, cn, row_number() over (order by sci, cn) as o from (select distinct {_NAME} as sci, lower(p_type) as cn from part union select {_NAME}, '"' || lower(p_type) || ' ' || split_part(p_name, ' ', 1) || '"@es' from part
  union select {_NAME}, split_part(p_name, ' ', 1) from part union select {_NAME}, lower(p_brand) from part)),
c as (select sci, trim(regexp_replace(cn, '"?@es$', ''), '" ') as cn from p), k as (select sci, cn, {sql_place("cn", "-")} as key from c),
f as (select * from k where key <> '' and not regexp_matches(key, '[0-9]') and not (strpos(key, ' ') = 0 and (length(key) < 5 or key in ({", ".join(quoted(w.replace("ñ", "n")) for w in vernacular.STOP)}) or key = lower(split_part(sci, ' ', 1)))))
select key as common_norm, min(cn) as common_display, array_to_string(list_sort(list(distinct sci)), '|') as scientific from f group by key
""")
def build_vernacular(spark, sf):
    read(spark, sf, "part").createOrReplaceTempView("_part")
    a = spark.sql(f"""select {_NAME} as sci, lower(p_type) as cn from _part union select {_NAME}, '"' || lower(p_type) || ' ' || split_part(p_name, ' ', 1) || '"@es' from _part
      union select {_NAME}, split_part(p_name, ' ', 1) from _part union select {_NAME}, lower(p_brand) from _part""")
    v = vernacular.build_vernacular(a.withColumn("ord", F.struct("cn", "sci")))
    return v.select("common_norm", "common_display", F.array_join("scientific", "|").alias("scientific"))


# questions and answers


@query("""
with t as """ + sql_rows("conversations", "conv_id, turn", "text", "'\\S+'") + """, n as (select conv_id, turn, len(regexp_extract_all(text, '\\S+')) as n from conversations),
w as (select conv_id, turn, n, unnest(range(0, greatest(1, ceil((n - 16) / 44.0)::int))) as w from n)
select conv_id, turn, w::int as w, (w * 44)::int as first, count(t.i)::int as n_tokens, min(t.s) as start, max(t.e) as "end" from w left join t using (conv_id, turn) where t.i is null or t.i between w * 44 + 1 and w * 44 + 60 group by conv_id, turn, w
""")
def qa_windows(spark, sf):
    w = qa.windows(read(spark, sf, "conversations"), "text", max_tokens=64, overlap=16, reserved=4)
    return w.select("conv_id", "turn", "w", "first", F.size("tokens").alias("n_tokens"), F.get("tokens", F.lit(0))["start"].alias("start"), F.element_at("tokens", -1)["end"].alias("end"))


@query("""
with e as (select label, vec_id as w, list_transform(embedding, lambda x: x::double) as s, list_reverse(list_transform(embedding, lambda x: x::double)) as t from embeddings),
a as (select label, w, i - 1 as si, s[i] as sv, row_number() over (partition by label, w order by s[i] desc, i) as r from (select *, unnest(range(1, len(s) + 1)) as i from e)),
b as (select label, w, i - 1 as ei, t[i] as ev, row_number() over (partition by label, w order by t[i] desc, i) as r from (select *, unnest(range(1, len(t) + 1)) as i from e)),
p as (select a.label, a.w, si, ei, sv + ev as score from a join b on a.label = b.label and a.w = b.w where a.r <= 20 and b.r <= 20 and si > 0 and ei >= si and ei - si <= 40),
c as (select label, max(s[1] + t[1]) as no_answer from e group by label), o as (select *, row_number() over (partition by label order by score desc, w, si, ei) as r from p)
select o.label, round(score, 6) as score, round(no_answer, 6) as no_answer, o.w, si::int as si, ei::int as ei from o join c using (label) where r = 1
""")
def best_span(spark, sf):
    e = read(spark, sf, "embeddings").select("label", F.col("vec_id").alias("w"), F.col("embedding").cast("array<double>").alias("start_logits"))
    b = qa.best_spans(e.withColumn("end_logits", F.reverse("start_logits")), ["label"])
    return b.select("label", F.round("score", 6).alias("score"), F.round("no_answer", 6).alias("no_answer"), "w", "si", "ei")


def _norm_sql(c: str) -> str:
    arts = ", ".join(quoted(a) for a in T.ARTICLES)
    return f"list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w <> '' and w not in ({arts}))"


_PAIRS = """pr as (select conv_id || '::' || turn || '::' || role as id, text as gold, coalesce(lead(text) over (partition by conv_id order by turn), '') as span, (length(text) % 97) / 97.0 as margin from conversations)"""
_SCORED = f"""
{_PAIRS}, rw as (select id, case when role_text = 'system' then null else gold end as gold, case when length(trim(span)) < 3 then '' else span end as span, case when length(trim(span)) < 3 then '-infinity'::double else margin::double end as margin
  from (select *, split_part(id, '::', -1) as role_text from pr)),
tk as (select *, {_norm_sql("span")} as p, {_norm_sql("gold")} as g from rw),
sm as (select *, coalesce(list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(g, lambda x: x = w))))), 0) as same from tk),
sc as (select id, margin, coalesce(gold, '') <> '' as has, span <> '' as any_, (array_to_string(p, ' ') = array_to_string(g, ' '))::int::double as em,
  case when len(p) = 0 and len(g) = 0 then 1.0 when len(p) = 0 or len(g) = 0 or same = 0 then 0.0 else 2.0 * same / (len(p) + len(g)) end as f1,
  (array_to_string(p, ' ') <> '' and array_to_string(g, ' ') <> '' and (contains(array_to_string(p, ' '), array_to_string(g, ' ')) or contains(array_to_string(g, ' '), array_to_string(p, ' '))))::int::double as cm from sm)"""


def answer_rows(spark, sf) -> DataFrame:
    """Each turn as the gold answer (none for system turns), the next turn as the span, and a margin from the length."""
    from pyspark.sql import Window as W

    c = read(spark, sf, "conversations")
    nxt = F.coalesce(F.lead("text").over(W.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    rows = c.select(F.concat_ws("::", "conv_id", "turn", "role").alias("id"), F.when(F.col("role") != "system", F.col("text")).alias("gold"), nxt.alias("span"), ((F.length("text") % 97) / 97.0).alias("margin"))
    return qa.eval_rows(rows)


@query(f"with {_SCORED} select id, round(em, 6) as em, round(f1, 6) as f1, cm > 0 as contains from sc")
def token_f1(spark, sf):
    return qa.judged(answer_rows(spark, sf)).select("id", F.round("em", 6).alias("em"), F.round("f1", 6).alias("f1"), (F.col("cm") > 0).alias("contains"))


def _metric_sql(yes: str) -> str:
    good = lambda c: f"round(avg(case when not has then (not ({yes}))::int::double when {yes} then {c} else 0.0 end), 6)"
    return f"""count(*) as n, {good("em")} as em, {good("f1")} as f1, {good("cm")} as contains, round(coalesce(count(*) filter (has and {yes}) / nullif(count(*) filter (has), 0), 0.0), 6) as ans_recall,
      count(*) filter (has and {yes}) as tp, count(*) filter (not has and {yes}) as fp, count(*) filter (has and not ({yes})) as fn, count(*) filter (not has and not ({yes})) as tn"""


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("em", "f1", "contains", "ans_recall")})


@query(f"with {_SCORED} select split_part(id, '::', -1) as tag, {_metric_sql('(margin >= 0.5 and any_)')} from sc group by 1")
def eval_by_tag(spark, sf):
    return rounded(qa.score_at(answer_rows(spark, sf), 0.5, by_tag=True))


_SWEEP = f"""{_SCORED}, ta as (select distinct round(margin, 2) as tau from sc where margin > '-infinity'::double union select -1e9::double), sw as (select tau, {_metric_sql("(margin >= tau and any_)")} from sc, ta group by tau)"""


@query(f"with {_SWEEP} select * from sw")
def threshold_sweep(spark, sf):
    return rounded(qa.threshold_sweep(answer_rows(spark, sf)))


@query(f"with {_SWEEP} select arg_min(tau, {{'f': -f1, 't': tau}}) as best_tau, max(f1) as best_f1 from sw")
def best_tau(spark, sf):
    b = qa.best_threshold(rounded(qa.threshold_sweep(answer_rows(spark, sf))))
    return b.select("best_tau", "best_f1")


@query("""
with d as (select distinct conv_id::varchar as d from conversations), r as (select d, row_number() over (order by md5(d || '0'), d) as k, count(*) over () as n from d)
select conv_id || '::' || turn as id, k <= floor(n * 0.1) as is_dev from conversations join r on r.d = conv_id::varchar
""")
def doc_split(spark, sf):
    e = read(spark, sf, "conversations").select(F.concat_ws("::", "conv_id", "turn").alias("id"))
    return qa.split_documents(e).select("id", "is_dev")


@query("""
with n as (select doc_id, row_number() over (order by md5(doc_id::varchar), doc_id) as k from labels where toxic = 0), m as (select floor(count(*) filter (toxic = 1) * 1.5) as m from labels)
select doc_id, quality, toxic from labels where toxic = 1 or doc_id in (select doc_id from n, m where k <= m)
""")
def neg_downsample(spark, sf):
    rows = read(spark, sf, "labels").withColumn("pos", F.col("toxic") == 1)
    return qa.downsample_negatives(rows, "pos", 1.5, ["doc_id"]).select("doc_id", "quality", "toxic")


_FEATURES = {"view": "wind_farm", "click": "power_line", "error": "monitoring_plan", "purchase": "protected_area", "signup": "unlisted"}


@query(f"""
with e as (select event_id, case event_type {" ".join(f"when '{k}' then '{v}'" for k, v in _FEATURES.items())} end as f, props from events),
q as (select event_id || '::' || f as id, case f {" ".join(f"when '{k}' then {quoted(v)}" for k, v in qa.THEMES.items())} end as question, substr(props, 2, 3) as answer from e)
select question, answer, count(*) as n, count(distinct id) as n_ids from q where question is not null group by question, answer
""")
def theme_questions(spark, sf):
    f = F.create_map(*(F.lit(x) for kv in _FEATURES.items() for x in kv))[F.col("event_type")]
    cache = read(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("props").alias("text"), F.create_map(f, F.array(F.struct(F.lit(1).alias("start"), F.lit(4).alias("end")))).alias("features"))
    q = qa.from_evidence(cache)
    return q.groupBy("question", F.get("answers.text", F.lit(0)).alias("answer")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"))


@query("""
with r as (select event_id, event_type, props, '<think>{"k": "no"}</think> sure: ' || replace(props, '"k": ', '"0": "') || ' ' as reply from events),
p as (select event_id, event_type, regexp_extract(props, '"k": ([0-9]+)', 1) as a, props from events)
select event_type, a as answer, (strpos(props, a) - 1)::int as start, count(*) as n from p where a <> '' group by all
""")
def teacher_parse(spark, sf):
    e = read(spark, sf, "events").select("event_type", F.col("props").alias("text"), F.concat(F.lit('<think>{"k": "no"}</think> sure: '), F.regexp_replace("props", '"k": ([0-9]+)', '"0": " \\\\"$1\\\\" "'), F.lit(" done")).alias("reply"))
    s = e.select("event_type", T.reply_span(T.parse_reply(F.col("reply"))["0"], F.col("text")).alias("s")).where("s is not null")
    return s.groupBy("event_type", "s.answer", "s.start").agg(F.count(F.lit(1)).alias("n"))


@query("""
with t as (select conv_id, turn, text, length(text) // 2 as s from conversations where length(text) >= 8), c as (select *, case when s + 4 <= 120 then 0 else greatest(0, s - 60) end as lo from t)
select conv_id, turn, substr(text, lo + 1, 120) as context, (s - lo)::int as start, substr(text, s + 1, 4) as answer from c
""")
def cap_context(spark, sf):
    c = read(spark, sf, "conversations").where("length(text) >= 8").withColumn("s", F.expr("cast(length(text) div 2 as int)"))
    e = c.select("conv_id", "turn", F.col("text").alias("context"), F.struct(F.array(F.substring(F.col("text"), F.col("s") + 1, F.lit(4))).alias("text"), F.array("s").alias("answer_start")).alias("answers"))
    e = qa.cap_context(e, 120)
    return e.select("conv_id", "turn", "context", F.get("answers.answer_start", F.lit(0)).alias("start"), F.get("answers.text", F.lit(0)).alias("answer"))


@query("""
with t as """ + sql_rows("conversations", "conv_id, turn", "text", "'\\S+'") + """,
n as (select conv_id, turn, length(text) // 2 as a, length(text) // 2 + 4 as b, len(regexp_extract_all(text, '\\S+')) as n from conversations),
w as (select *, unnest(range(0, greatest(1, ceil((n - 16) / 44.0)::int))) as w from n),
i as (select conv_id, turn, w, count(t.i) as n, coalesce(min(t.s) <= any_value(a) and max(t.e) >= any_value(b), false) as ok, count(*) filter (t.s <= a) as f, count(*) filter (t.e >= b) as l
  from w left join t using (conv_id, turn) where t.i is null or t.i between w * 44 + 1 and w * 44 + 60 group by conv_id, turn, w)
select conv_id, turn, w::int as w, case when ok then f else 0 end::int as first, case when ok then n - l + 1 else 0 end::int as last from i
""")
def answer_windows(spark, sf):
    c = read(spark, sf, "conversations").withColumn("a", F.expr("cast(length(text) div 2 as int)"))
    w = qa.windows(c, "text", max_tokens=64, overlap=16, reserved=4).withColumn("x", qa.answer_tokens_in(F.col("tokens"), F.col("a"), F.col("a") + 4))
    return w.select("conv_id", "turn", "w", "x.first", "x.last")



"""Graphs and tables derived from the driver's tables, as SQL that Spark and DuckDB both run.

``{join:x;sep}`` stands for the distinct values of x, sorted and joined; each dialect has its own words for it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

DERIVED = {
    # Tree of depth 3.
    "geo": """select 'geo' as graph_id, 'WORLD' as parent, r_name as child from region
        union select 'geo', r_name, n_name from nation join region on n_regionkey = r_regionkey
        union select 'geo', n_name, concat('C', c_custkey) from customer join nation on c_nationkey = n_nationkey""",
    # Acyclic, several parents, with shortcuts.
    "parts": """select 'parts' as graph_id, 'part' as parent, p_type as child from part
        union select 'parts', p_type, p_brand from part where p_size > 35
        union select 'parts', p_brand, p_name from part where p_size <= 10
        union select 'parts', 'part', split_part(p_name, ' ', 2) from part
        union select 'parts', split_part(p_name, ' ', 2), p_name from part
        union select 'parts', 'part', p_brand from part where substr(md5(p_brand), 1, 1) < '8'""",
    "parts_pred": """select 'parts' as graph_id, parent, child from parts where substr(md5(concat(parent, '>', child)), 1, 1) < 'c'
        union select 'parts', p_type, split_part(p_name, ' ', 2) from part where substr(md5(concat(p_type, p_name)), 1, 1) < '4'""",
    "parts_other": """select 'parts' as graph_id, parent, child from parts where substr(md5(concat(child, '<', parent)), 1, 1) < '9'
        union select 'parts', p_brand, split_part(p_name, ' ', 2) from part where substr(md5(concat(p_brand, p_name)), 1, 1) < '2'""",
    # Grows with the tables.
    "sales": """select 'sales' as graph_id, concat('C', o_custkey) as parent, concat('O', o_orderkey) as child from orders
        union select 'sales', concat('O', l_orderkey), concat('P', l_partkey) from lineitem""",
    # Grows with the tables and is 24 edges deep; some nodes have two parents.
    "deep": """select distinct 'deep' as graph_id, concat('c', o_custkey - 1 - case when o_orderkey % 20 = 0 then 25 else 0 end) as parent, concat('c', o_custkey) as child
        from orders where o_custkey % 25 > 0 and o_custkey > 26""",
    "deep_pred": """select graph_id, parent, child from deep where substr(md5(concat(parent, '>', child)), 1, 1) < 'e'
        union select 'deep', concat('c', c_custkey - 3), concat('c', c_custkey) from customer where c_custkey % 11 = 0 and c_custkey > 3""",
    # Weighted and cyclic, with loops.
    "flow": """select 'flow' as graph_id, event_type as parent, nxt as child, cast(count(*) as double) as weight
        from (select event_type, lead(event_type) over (partition by user_id order by ts, event_id) as nxt from events) t
        where nxt is not null group by event_type, nxt""",
    # Partly cyclic; a set of nodes for every thousand parts.
    "ring": """select 'ring' as graph_id, concat('n', block, '-', a) as parent, concat('n', block, '-', b % 97) as child from (
            select l_partkey - l_partkey % 1000 as block, l_partkey % 97 as a, sum(l_orderkey * 7 + l_linenumber) as b from lineitem group by l_partkey - l_partkey % 1000, l_partkey % 97
            union select l_partkey - l_partkey % 1000, l_suppkey % 31, sum(l_orderkey + l_partkey) from lineitem group by l_partkey - l_partkey % 1000, l_suppkey % 31) t""",
    # Pairs that name each other as parent, under nouns; anew for every hundred parts.
    "block_part": "select distinct concat(p_name, ' ', p_partkey - p_partkey % 100) as name, concat(split_part(p_name, ' ', 2), ' ', p_partkey - p_partkey % 100) as noun from part",
    "syn": """select 'syn' as graph_id, name as parent, replace(name, 'old ', 'hot ') as child from block_part where name like 'old %'
        union select 'syn', replace(name, 'old ', 'hot '), name from block_part where name like 'old %'
        union select 'syn', noun, name from block_part""",
    "nouns": "select split_part(p_name, ' ', 2) as noun, min(p_name) as lo, max(p_name) as hi from part group by split_part(p_name, ' ', 2)",
    "lemma_gt": """select distinct 'lemma' as graph_id, p_type as parent, concat(noun, ' (', noun, ', ', lo, ', ', hi, ')') as child
        from part join nouns on noun = split_part(p_name, ' ', 2) where substr(md5(concat(p_type, noun)), 1, 1) < '8'""",
    "lemma_pred": """select distinct 'lemma' as graph_id, p_type as parent, concat(lo, '|', noun) as child
        from part join nouns on noun = split_part(p_name, ' ', 2) where substr(md5(concat(noun, p_type)), 1, 1) < 'a'""",
    "lemma_nodes": "select parent as node from lemma_gt union select child from lemma_gt union select child from lemma_pred union select n_name from nation",
    "result": """select concat('N', c_nationkey, case when o_orderkey % 2 = 0 then '_SUB' else '_FULL' end) as dataset,
        concat('Our Method [', lower(o_orderstatus), '] (k=1000, clawback=', (o_orderkey % 4) * 5, ')') as method,
        round(avg(o_totalprice) / 1000000, 6) as f1, count(*) as n from orders join customer on o_custkey = c_custkey group by 1, 2""",
    "runs": """select dataset, method, case when n % 3 = 0 then true else false end as use_synsets, false as explode_nodes, f1, cast(n as int) as ordinal,
        concat('m', n % 3) as model, cast(n as double) as runtime from result""",
    "profile": """select concat('N', n_nationkey, '_SUB') as dataset, count(*) as nodes, round(avg(c_acctbal), 3) as depth from customer join nation on c_nationkey = n_nationkey group by n_nationkey
        union all select concat('N', n_nationkey, '_FULL'), 2 * count(*), round(sum(c_acctbal) / 1000, 3) from customer join nation on c_nationkey = n_nationkey where n_name > 'C' group by n_nationkey""",
    "ppl": """select concat('P', l_partkey) as child, concat('S', l_suppkey) as parent, cast(min(l_quantity) / 5 as double) as ppl from lineitem group by l_partkey, l_suppkey
        union all select concat('S', l_suppkey), concat('P', l_partkey), cast(max(l_discount) * 10 as double) from lineitem group by l_partkey, l_suppkey""",
    "vocab": "select name as primary, name as node from named union select noun, noun from named",
    # Every part has a name of its own; nouns are anew for every hundred parts, so replies have a bounded length.
    "named": "select concat(p_name, ' ', p_partkey) as name, concat(split_part(p_name, ' ', 2), ' ', p_partkey - p_partkey % 100) as noun, p_brand from part",
    "lines": """select 'r' as run_id, noun as target, cast(0 as int) as chunk, concat({join:concat('- ', name, ' <= ', noun);chr(10)}, chr(10), 'x <= y <= z', chr(10), {join:concat(upper(name), ' <= ', p_brand);chr(10)}) as text
        from named group by noun""",
    "arrays": """select 'r' as run_id, noun as target, cast(0 as int) as chunk, concat('Here: [', {join:concat('["', case when name like '%d%' then name else upper(name) end, '", "', noun, '"]');', '}, case when noun like '%g%' then ', [' else '' end, ']') as text
        from named group by noun""",
    "objects": """select 'r' as run_id, noun as target, cast(0 as int) as chunk, {join:concat('{"PARENT": "', noun, '", "child" : "', upper(name), '"}');', '} as text from named group by noun""",
    "replies": """select 'r' as run_id, noun as target, cast(0 as int) as chunk, case when noun like '%g%' then 'none' else {join:concat(name, ' <= ', noun);chr(10)} end as content,
        {join:concat(noun, ' <= ', name);chr(10)} as reasoning from named group by noun""",
    "diag": """select concat('d', l_suppkey % 4) as graph_id, concat('p', l_orderkey, '-', l_partkey) as parent, concat('c', l_linenumber, '-', l_suppkey) as child, l_quantity * 3 as leverage, l_discount * 10 as neighborhood_agreement,
        cast(l_linenumber % 3 as bigint) as votes, cast(l_quantity as bigint) as salience, case when l_returnflag = 'R' then 1 else 0 end as is_fp
        from lineitem""",
    "reasons": """select concat('d', o_custkey % 5) as graph_id, case when o_orderpriority like '1%' then 'gt_missing' when o_orderpriority like '2%' then 'not_isa' else 'unclear' end as bucket from orders""",
    "log": """select concat('d', user_id % 3) as dataset, event_type as variant, cast(floor(value) as bigint) as reasoning_chars, cast(event_id % 5 as int) as edges, event_id % 5 > 0 as produced from events""",
}

_JOIN = re.compile(r"\{join:(.*?);(chr\(10\)|'[^']*')\}", re.S)


def _sql(name: str, dialect: str) -> str:
    form = r"array_join(array_sort(collect_set(\1)), \2)" if dialect == "spark" else r"array_to_string(list_sort(list(distinct \1)), \2)"
    return _JOIN.sub(form, DERIVED[name])


def needed(name: str, seen: list[str] | None = None) -> list[str]:
    """The derived tables a derived table is made of, itself last."""
    seen = [] if seen is None else seen
    for other in DERIVED:
        if other != name and other not in seen and re.search(rf"\b(from|join) {other}\b", DERIVED[name]):
            needed(other, seen)
    if name not in seen:
        seen.append(name)
    return seen


def ctes(*names: str) -> str:
    """DuckDB ``with`` clause for derived tables; ``x_c`` is the closure (graph_id, a, d) of x."""
    out: list[str] = []
    done: list[str] = []
    for name in names:
        base = name[:-2] if name.endswith("_c") else name
        for n in needed(base):
            if n not in done:
                done.append(n)
                out.append(f"{n} as ({_sql(n, 'duckdb')})")
        if name.endswith("_c") and name not in done:
            done.append(name)
            out.append(f"{name}(graph_id, a, d) as (select graph_id, parent, child from {base} union select c.graph_id, c.a, e.child from {name} c join {base} e on e.graph_id = c.graph_id and e.parent = c.d)")
    return "with recursive " + ",\n".join(out) + "\n"


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a derived one."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = "with " + ",\n".join(f"{n} as ({_sql(n, 'spark')})" for n in needed(name)) + f"\nselect * from {name}"
    for t in TABLES:
        if re.search(rf"\b(from|join) {t}\b", text):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(text)

"""One query per operator over graphs derived from the driver's tables, with the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions import text as T
from treeline.operators import analytics as A
from treeline.operators import candidates as C
from treeline.operators import finetune as N
from treeline.operators import graph as R
from treeline.operators import replies as P
from treeline.operators import scoring as M
from treeline.plans.fixtures import ctes, frame
from treeline.tables import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KS = [0, 1, 3, 10, 25]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda table: frame(spark, sf_dir, table))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def r12(*names: str):
    """For means of few rounded numbers, which often end in a 5 at the seventh place."""
    return [F.round(n, 12).alias(n) for n in names]


# Text functions. SQL macros of the same, for DuckDB.
CLEAN = r"trim(regexp_replace(regexp_replace(lower(trim({0})), '[^\p{{L}}\p{{N}}_\s\-]', '', 'g'), '\s+', ' ', 'g'))"
LOW = "trim(lower({0}))"
PACKED = r"regexp_matches({0}, '^([^(]+)\s*\((.*)\)$')"
HEAD = r"trim(regexp_extract({0}, '^([^(]+)\s*\((.*)\)$', 1))"
ITEMS = r"list_filter(list_transform(string_split(regexp_extract({0}, '^([^(]+)\s*\((.*)\)$', 2), ','), lambda x: trim(x)), lambda x: x <> '')"


def lemma_sql(c: str) -> str:
    n = LOW.format(c)
    items, head, packed = ITEMS.format(n), HEAD.format(n), PACKED.format(n)
    parts = f"case when contains({n}, '|') then list_filter(list_transform(string_split({n}, '|'), lambda x: trim(x)), lambda x: x <> '') else [{n}] end"
    return f"(case when {packed} then case when {items}[1] = {head} then {items} else [{n}] end else {parts} end)"


def primary_sql(c: str) -> str:
    n = LOW.format(c)
    return f"(case when {PACKED.format(n)} and {ITEMS.format(n)}[1] = {HEAD.format(n)} then {HEAD.format(n)} else {n} end)"


@query("t1_clean_term", f"select doc_id, {CLEAN.format('text')} as term from documents")
def _(t):
    return t("documents").select("doc_id", T.clean_term("text").alias("term"))


@query("t2_primary_term", ctes("lemma_nodes") + f"select node, {primary_sql('node')} as term from lemma_nodes")
def _(t):
    return t("lemma_nodes").select("node", T.primary_term("node").alias("term"))


@query("t3_parse_lemma", ctes("lemma_nodes") + f"select node, array_to_string({lemma_sql('node')}, ';') as forms, cast(len({lemma_sql('node')}) as int) as n from lemma_nodes")
def _(t):
    return t("lemma_nodes").select("node", F.array_join(T.parse_lemma("node"), ";").alias("forms"), F.size(T.parse_lemma("node")).alias("n"))


@query(
    "t4_to_lemma",
    ctes("nouns")
    + f""", f as (select noun, lo, hi, [{CLEAN.format('hi')}, {CLEAN.format('noun')}, {CLEAN.format('lo')}] as l from nouns),
g as (select noun, list_filter(list_transform(list_zip(l, range(1, 4)), lambda x: case when list_position(l, x[1]) = x[2] then x[1] end), lambda x: x is not null) as u from f)
select noun, case when len(u) = 1 then u[1] else concat(u[1], ' (', array_to_string(u, ', '), ')') end as lemma from g""",
)
def _(t):
    return t("nouns").select("noun", T.lemma_of(F.array(F.concat(F.upper("hi"), F.lit("!")), F.concat("noun", F.lit("|"), "lo"))).alias("lemma"))


@query(
    "t5_parse_label",
    ctes("result")
    + r"""select dataset, method, trim(regexp_replace(method, '\s*\(.*\)\s*', '')) as base_method, cast(regexp_extract(method, '[^a-z]k=([0-9]+)', 1) as int) as k,
cast(regexp_extract(method, 'clawback=([0-9]+)', 1) as int) as clawback, regexp_extract(method, '\[([^\]]+)\]', 1) as variant,
case when regexp_extract(method, 'clawback=([0-9]+)', 1) = '0' then 'Raw' else concat('Clawback(k=', regexp_extract(method, 'clawback=([0-9]+)', 1), ')') end as strategy from result""",
)
def _(t):
    return t("result").select("dataset", "method", T.parse_label("method").alias("_l")).select("dataset", "method", "_l.base_method", "_l.k", "_l.clawback", "_l.variant", "_l.strategy")


@query("t6_size_bucket", "select p_partkey, case when p_partkey * p_size <= 150 then '0-150' when p_partkey * p_size <= 1000 then '151-1000' when p_partkey * p_size <= 10000 then '1001-10000' else '10001+' end as size from part")
def _(t):
    return t("part").select("p_partkey", T.size_bucket(F.col("p_partkey") * F.col("p_size")).alias("size"))


_VERDICT = "concat('Should one ', case when o_orderpriority like '1%' then 'Keep' when o_orderpriority like '2%' then 'SEVER' else 'keepsake' end, ' it? ', case when o_orderstatus = 'O' then 'sever.' when o_orderstatus = 'F' then 'KEEP!' else '' end)"


@query("t7_decide_sever", rf"select o_orderkey, coalesce(regexp_extract_all(lower({_VERDICT}), '\b(keep|sever)\b', 1)[-1] = 'sever', false) as sever from orders")
def _(t):
    return t("orders").select("o_orderkey", T.decide_sever(F.expr(_VERDICT)).alias("sever"))


_REASON = "concat('Maybe ', case when o_orderpriority like '1%' then 'GT_missing' when o_orderpriority like '3%' then 'not_isa' else 'nothing' end, ' or ', case when o_orderstatus = 'O' then 'wrong_parent' when o_orderstatus = 'F' then 'gt_missing' else '?' end)"


@query("t8_parse_bucket", f"""select o_orderkey, case when o_orderstatus = 'O' then 'wrong_parent' when o_orderstatus = 'F' then 'gt_missing' when o_orderpriority like '1%' then 'gt_missing' when o_orderpriority like '3%' then 'not_isa' else 'unclear' end as bucket from orders""")
def _(t):
    return t("orders").select("o_orderkey", T.parse_bucket(F.expr(_REASON)).alias("bucket"))


@query("t9_hearst_sentence", ctes("parts") + "select parent, child, concat('A ', child, ' is a type of ', parent, '.') as sentence from parts")
def _(t):
    return t("parts").select("parent", "child", T.hearst_sentence("child", "parent").alias("sentence"))


# Replies.
_LINES = """, l as (select run_id, target, chunk, unnest(string_split(lower(text), chr(10))) as l from lines), p as (select run_id, target, chunk, string_split(l, '<=') as p from l),
e as (select run_id, target, chunk, trim(trim(p[2]), '-''" ') as up, trim(trim(p[1]), '-''" ') as low from p where len(p) = 2),
known as (select run_id, target, chunk, a.node as parent, b.node as child from e join vocab a on a.primary = up join vocab b on b.primary = low)"""
_ARRAYS = r""", m as (select run_id, target, chunk, unnest(regexp_extract_all(text, '\["([^"]+)", "([^"]+)"\]', 1)) as up, unnest(regexp_extract_all(text, '\["([^"]+)", "([^"]+)"\]', 2)) as low from arrays)"""


@query("p1_parse_arrow_lines", ctes("vocab", "lines") + _LINES + " select target, parent, child, count(*) as n from known group by all")
def _(t):
    return P.parse_arrow_lines(t("lines"), t("vocab")).groupBy("target", "parent", "child").agg(F.count("*").alias("n"))


@query(
    "p2_parse_json_pairs",
    ctes("vocab", "arrays") + _ARRAYS + """, ok as (select m.* from m join arrays using (run_id, target, chunk) where not contains(text, ', [') or contains(text, '], ["'))
select target, a.node as parent, b.node as child, count(*) as n from m join vocab a on a.primary = up join vocab b on b.primary = low where target not like '%g%' group by all""",
)
def _(t):
    return P.parse_json_pairs(t("arrays"), t("vocab")).groupBy("target", "parent", "child").agg(F.count("*").alias("n"))


@query("p3_parse_pair_regex", ctes("vocab", "arrays") + _ARRAYS + " select target, a.node as parent, b.node as child, count(*) as n from m join vocab a on a.primary = lower(up) join vocab b on b.primary = lower(low) where a.node <> b.node group by all")
def _(t):
    return P.parse_pair_regex(t("arrays"), t("vocab"), drop_self=True).groupBy("target", "parent", "child").agg(F.count("*").alias("n"))


@query("p4_parse_objects", ctes("objects") + " select distinct noun as target, noun as parent, name as child from named where name <> noun")
def _(t):
    return P.parse_parent_child_objects(t("objects")).select("target", "parent", "child")


_DIAG = """, d as (select target, target not like '%g%' as regex_match, target not like '%g%' as json_ok, (select count(*) from (select distinct name from named where noun = target and name like '%d%')) as dn,
(select count(distinct name) from named where noun = target) as nn from arrays),
diag as (select target, regex_match, json_ok, case when json_ok then dn else 0 end as n_strict, case when json_ok then nn else 0 end as n_json_ci, nn as n_regex_ci, cast(0 as bigint) as n_line, nn as n_pairs_wellformed from d)"""


@query("p5_parse_diagnostics", ctes("arrays") + _DIAG + " select * from diag")
def _(t):
    return P.parse_diagnostics(t("arrays"), t("vocab")).drop("run_id", "chunk")


@query(
    "p6_parse_loss_summary",
    ctes("arrays") + _DIAG + """ select count(*) as n, count(*) filter (regex_match) as blocks, count(*) filter (json_ok) as json_ok, cast(sum(n_strict) as bigint) as n_strict, cast(sum(n_json_ci) as bigint) as n_json_ci,
cast(sum(n_regex_ci) as bigint) as n_regex_ci, cast(0 as bigint) as n_line, cast(sum(n_pairs_wellformed) as bigint) as n_pairs_wellformed, cast(sum(n_json_ci - n_strict) as bigint) as case_loss, cast(sum(n_regex_ci - n_json_ci) as bigint) as json_fail_recovery,
cast(0 as bigint) as out_of_vocab, case when sum(n_regex_ci - n_strict) > greatest(1, sum(n_strict)) * 0.15 then 'parsing_loss' else 'not_parsing' end as verdict from diag""",
)
def _(t):
    return P.parse_loss_summary(P.parse_diagnostics(t("arrays"), t("vocab")))


@query(
    "p7_assertions_to_edges",
    ctes("named") + """, a as (select distinct noun as target, case when noun like '%g%' then name else noun end as parent, case when noun like '%g%' then noun else name end as child from named)
select target, parent, child, cast(1 as bigint) as n from a""",
)
def _(t):
    edges, salience = P.assertions_to_edges(t("replies"), t("vocab"))
    return edges.join(salience, ["run_id", "parent", "child"]).select("target", "parent", "child", "n")


# Candidates.
@query("c1_lexical_edges", ctes("parts") + """, n as (select parent as node from parts union select child from parts)
select 'parts' as graph_id, a.node as parent, b.node as child from n a join n b on a.node <> b.node and length(a.node) > 3 and contains(lower(b.node), lower(a.node)) and lower(a.node) <> lower(b.node)""")
def _(t):
    return C.lexical_edges(R.nodes_of(t("parts")))


_EMB = "select concat('v', repeat('x', cast(vec_id % 7 as int)), vec_id) as name, embedding as vec from embeddings"


def _emb(t) -> DataFrame:
    return t("embeddings").selectExpr("concat('v', repeat('x', cast(vec_id % 7 as int)), vec_id) as name", "embedding as vec")


@query("c2_vector_edges", f"with e as ({_EMB}) select a.name as parent, b.name as child from e a join e b on a.name <> b.name and length(a.name) < length(b.name) and list_cosine_similarity(a.vec::double[], b.vec::double[]) > 0.35")
def _(t):
    return C.vector_edges(_emb(t), 0.35).select("parent", "child")


@query("c3_nearest_parent", f"with e as ({_EMB}), s as (select a.name as child, b.name as parent, list_cosine_similarity(a.vec::double[], b.vec::double[]) as s from e a join e b on a.name <> b.name) select child, arg_max(parent, s) as parent from s group by child")
def _(t):
    return C.nearest_parent(_emb(t), _emb(t)).select("child", "parent")


@query(
    "c4_perplexity_parents",
    ctes("ppl") + """, k as (select a.child, a.parent, a.ppl as weight, row_number() over (partition by a.child order by a.ppl, a.parent) as r from ppl a join ppl b on a.child = b.parent and a.parent = b.child where b.ppl <> 0 and a.ppl / b.ppl < 15)
select parent, child, weight from k where r <= 3""",
)
def _(t):
    return C.perplexity_parents(t("ppl"))


@query(
    "c5_extraction_requests",
    ctes("parts") + """, n as (select distinct lower(trim(node)) as term from (select parent as node from parts union select child from parts)), s as (select count(*) - 1 as m from n)
select term as target, cast(c as bigint) as chunk, cast(least(40, m - c * 40) as bigint) as n_candidates from n, s, range(0, 100) r(c) where c * 40 < m""",
)
def _(t):
    return C.extraction_requests(R.nodes_of(t("parts")), 40).select("target", "chunk", "n_candidates")


@query(
    "c6_batch_requests",
    ctes("parts", "geo") + """, tn as (select (row_number() over (order by node) - 1) // 50 as c, node from (select distinct child as node from parts)), tr as (select (row_number() over (order by parent, child) - 1) // 50 as c from parts),
a as (select c as test_chunk, string_agg(node, chr(10) order by node) as terms from tn group by c), b as (select c as train_chunk, count(*) as k from tr group by c) select train_chunk, test_chunk, terms, k as n_examples from a, b""",
)
def _(t):
    e = t("parts")
    out = C.batch_requests(e.select("graph_id", F.col("child").alias("node")), e, 50)
    return out.select("train_chunk", "test_chunk", "terms", F.regexp_count("examples", F.lit('"parent":')).cast("long").alias("n_examples"))


@query("c7_needed_pairs", ctes("lemma_gt") + f"select {primary_sql('child')} as child, {primary_sql('parent')} as parent from lemma_gt union select {primary_sql('parent')}, {primary_sql('child')} from lemma_gt")
def _(t):
    return C.needed_pairs(t("lemma_gt"))


# Graphs.
@query("g1_closure", ctes("parts_c", "ring_c") + "select graph_id, a as ancestor, d as descendant from parts_c union all select graph_id, a, d from ring_c")
def _(t):
    return R.transitive_closure(t("parts").union(t("ring"))).drop("hops")


@query("g1_closure_sales", ctes("sales_c") + "select a as ancestor, count(*) as n from sales_c group by a")
def _(t):
    return R.reach_counts(t("sales"), numbers=False).select("ancestor", "n")


@query("g1_small_closures", ctes("parts_c", "ring_c", "geo_c") + "select graph_id, a as ancestor, d as descendant from parts_c union all select graph_id, a, d from ring_c union all select graph_id, a, d from geo_c")
def _(t):
    return R.small_closures(t("parts").union(t("ring")).union(t("geo")))


_HOPS = """, h(graph_id, a, d, h) as (select graph_id, parent, child, 1 from {0} union select h.graph_id, h.a, e.child, h.h + 1 from h join {0} e on e.graph_id = h.graph_id and e.parent = h.d)"""


@query("g1_hops", ctes("parts", "geo") + _HOPS.format("parts") + " select graph_id, a as ancestor, d as descendant, cast(min(h) as int) as hops from h group by all")
def _(t):
    return R.transitive_closure(t("parts"))


@query("g1_closure_deep", ctes("deep") + _HOPS.format("deep") + " select a as ancestor, count(distinct d) as n, cast(max(m) as int) as most from (select a, d, min(h) as m from h group by a, d) group by a")
def _(t):
    return R.reach_counts(t("deep")).select("ancestor", "n", "most")


_RED = ", red as (select * from parts p where not exists (select 1 from parts q join parts_c c on c.a = q.child where q.parent = p.parent and c.d = p.child))"


@query("g2_reduction", ctes("parts_c") + _RED + " select * from red")
def _(t):
    return R.transitive_reduction(t("parts"), R.transitive_closure(t("parts")))


@query("g3_implied", ctes("parts_c") + _RED + " select graph_id, a as ancestor, d as descendant from parts_c except select graph_id, parent, child from red")
def _(t):
    c = R.transitive_closure(t("parts"))
    return R.implied_edges(c, R.transitive_reduction(t("parts"), c))


@query("g4_is_dag", ctes("parts_c", "ring_c", "geo_c") + "select graph_id, bool_and(a <> d) as is_dag from (select * from parts_c union all select * from ring_c union all select * from geo_c) group by graph_id")
def _(t):
    return R.is_dag(t("parts").union(t("ring")).union(t("geo")))


_SCC = ", n as (select parent as node from ring union select child from ring), scc as (select node, coalesce((select min(x.d) from ring_c x join ring_c y on x.a = y.d and x.d = y.a where x.a = node), node) as scc from n)"


@query("g5_scc", ctes("ring_c") + _SCC + " select 'ring' as graph_id, node, scc from scc")
def _(t):
    return R.scc(t("ring"))


_COMP = """, mu as (select a.parent as x, a.child as y from syn a join syn b on a.parent = b.child and a.child = b.parent), n as (select parent as node from syn union select child from syn),
reach(node, r) as (select node, node from n union select reach.node, mu.y from reach join mu on mu.x = reach.r), comp as (select node, min(r) as component from reach group by node)"""


@query("g6_mutual_components", ctes("syn") + _COMP + " select 'syn' as graph_id, node, component from comp")
def _(t):
    return R.mutual_components(t("syn"))


@query(
    "g7_condense_synonyms",
    ctes("syn") + _COMP + """, nm as (select component, case when count(*) > 1 then concat(min(node), ' (', string_agg(node, ', ' order by node), ')') else min(node) end as c from comp group by component),
mp as (select node, c from comp join nm using (component)) select distinct 'syn' as graph_id, a.c as parent, b.c as child from syn join mp a on a.node = parent join mp b on b.node = child where a.c <> b.c""",
)
def _(t):
    return R.condense_synonyms(t("syn"))[0]


_ROOTS = ", roots as (select parent as node from {0} except select child from {0}), b(node, h) as (select node, 0 from roots union select e.child, b.h + 1 from b join {0} e on e.parent = b.node where b.h < 200), dep as (select node, min(h) as depth from b group by node)"


@query(
    "g8_break_cycles_order",
    ctes("ring_c") + _SCC + _ROOTS.format("ring") + """, k as (select node, scc, coalesce(depth, 1 << 30) as dd from scc left join dep using (node))
select graph_id, parent, child from ring join k p on p.node = parent join k c on c.node = child where p.scc <> c.scc or (p.dd, p.node) < (c.dd, c.node)""",
)
def _(t):
    return R.break_cycles(t("ring"))


# An edge goes if edges that would go later lead from its child back to its parent.
@query(
    "g8_break_cycles_weight",
    ctes("flow") + """, o as (select *, row_number() over (order by weight desc, parent, child) as no from flow where parent <> child),
back(no, node) as (select no, child from o union select b.no, e.child from back b join o e on e.parent = b.node and e.no > b.no)
select graph_id, parent, child, weight from o where (no, parent) not in (select no, node from back)""",
)
def _(t):
    return R.break_cycles(t("flow"), "weight")


@query("g9_add_virtual_root", ctes("sales", "geo") + """, e as (select * from sales union all select * from geo), rt as (select graph_id, parent as node from e except select graph_id, child from e)
select * from e union all select graph_id, 'virtual_root', node from rt where graph_id in (select graph_id from rt group by 1 having count(*) > 1)""")
def _(t):
    return R.add_virtual_root(t("sales").union(t("geo")))


@query(
    "g10_node_degrees",
    ctes("sales") + """, x as (select child as node, 1 as i, 0 as o from sales union all select parent, 0, 1 from sales)
select node, cast(sum(i) as bigint) as in_degree, cast(sum(o) as bigint) as out_degree, sum(i) = 0 as is_root, sum(o) = 0 as is_leaf from x group by node""",
)
def _(t):
    return R.node_degrees(t("sales")).drop("graph_id")


_WEAK = """, un as (select parent as x, child as y from {0} union select child, parent from {0}), wr(node, r) as (select x, x from un union select wr.node, un.y from wr join un on un.x = wr.r), wk as (select node, min(r) as component from wr group by node)"""


@query("g11_weak_components", ctes("ring", "syn") + _WEAK.format("ring") + _WEAK.format("syn").replace("un as", "un2 as").replace("un.", "un2.").replace(" un ", " un2 ").replace("wr(", "wr2(").replace("wr.", "wr2.").replace("from wr ", "from wr2 ").replace("wk as", "wk2 as").replace("from un union", "from un2 union") + " select 'ring' as graph_id, node, component from wk union all select 'syn', node, component from wk2")
def _(t):
    return R.weak_components(t("ring").union(t("syn")))


@query(
    "g12_longest_path_layers",
    ctes("parts", "ring_c") + """, roots as (select parent as node from parts except select child from parts), b(node, h) as (select node, 0 from roots union select e.child, b.h + 1 from b join parts e on e.parent = b.node), n as (select parent as node from ring union select child from ring)
select 'parts' as graph_id, node, cast(max(h) as int) as layer from b group by node union all select 'ring', node, cast((select count(*) from ring_c where d = node and a <> node) as int) from n""",
)
def _(t):
    return R.longest_path_layers(t("parts").union(t("ring")))


@query("g12_longest_path_deep", ctes("deep") + ", roots as (select parent as node from deep except select child from deep), b(node, h) as (select node, 0 from roots union select e.child, b.h + 1 from b join deep e on e.parent = b.node) select node, cast(max(h) as int) as layer from b group by node")
def _(t):
    return R.longest_path_layers(t("deep")).select("node", "layer")


@query("g13_min_depth", ctes("parts") + _ROOTS.format("parts") + " select 'parts' as graph_id, node, cast(depth as int) as depth from dep")
def _(t):
    return R.min_depth(t("parts"))


@query("g14_reachable_subgraph", ctes("parts_c") + "select * from parts where parent in (select d from parts_c where a in (select p_type from part) union select p_type from part)")
def _(t):
    return R.reachable_subgraph(t("parts"), t("part").select(F.lit("parts").alias("graph_id"), F.col("p_type").alias("node")))


@query("g15_induced_subgraph", ctes("parts") + "select * from parts where parent in (select p_brand from part union select p_name from part) and child in (select p_brand from part union select p_name from part)")
def _(t):
    nodes = t("part").select(F.lit("parts").alias("graph_id"), F.col("p_brand").alias("node")).union(t("part").select(F.lit("parts"), "p_name"))
    return R.induced_subgraph(t("parts"), nodes)


@query(
    "g16_closed_sample",
    ctes("parts_c") + """, n as (select parent as node from parts union select child from parts), rk as (select node, row_number() over (order by md5(concat('42:', node)), node) as r from n),
f as (select x.a as node, min(r) as f from (select a, d from parts_c union select node, node from n) x join rk on rk.node = x.d group by x.a), c as (select f, sum(count(*)) over (order by f) as s from f group by f),
st as (select coalesce(min(f) filter (s >= 40), max(f)) as stop from c), k as (select node from f, st where f <= stop) select * from parts where parent in (select node from k) and child in (select node from k)""",
)
def _(t):
    return R.closed_sample(t("parts"), 40)


@query(
    "g17_branch_split",
    ctes("geo_c") + """, roots as (select parent as node from geo except select child from geo), br as (select parent as r, child as s, row_number() over (order by md5(concat('42:', parent, ':', child)), parent, child) as k, count(*) over () as n from geo where parent in (select node from roots)),
b as (select r, s, k <= greatest(1, floor(n * 0.2)) as tr from br), m as (select d as node, tr from b join geo_c on a = s union all select s, tr from b union all select r, tr from b), w as (select node, bool_and(tr) as tr from m group by node)
select 'test' as part, parent, child from geo where parent in (select node from w where not tr) and child in (select node from w where not tr)
union all select 'train', parent, child from geo where parent in (select node from w where tr) and child in (select node from w where tr)""",
)
def _(t):
    test, train = R.branch_split(t("geo"))
    return test.select(F.lit("test").alias("part"), "parent", "child").union(train.select(F.lit("train"), "parent", "child"))


_FORMS = f""", nn as (select parent as node from lemma_gt union select child from lemma_gt), fm as (select {lemma_sql('node')} as l from nn), cl as (select unnest(l) as parent, l from fm),
cx as (select unnest({lemma_sql('parent')}) as parent, {lemma_sql('child')} as l from lemma_gt), xg as (select distinct parent, child from (select parent, unnest(l) as child from cl union all select parent, unnest(l) from cx) where parent <> child)"""


@query("g18_explode_graph", ctes("lemma_gt") + _FORMS + " select * from xg")
def _(t):
    return R.explode_graph(t("lemma_gt")).drop("graph_id")


@query(
    "g19_neighbourhood",
    ctes("parts") + """, x as (select e.parent, e.child, 'parent_parents' as kind, p.parent as n from parts e join parts p on p.child = e.parent union all select e.parent, e.child, 'parent_children', p.child from parts e join parts p on p.parent = e.parent and p.child <> e.child
union all select e.parent, e.child, 'child_parents', p.parent from parts e join parts p on p.child = e.child and p.parent <> e.parent union all select e.parent, e.child, 'child_children', p.child from parts e join parts p on p.parent = e.child
union all select e.parent, e.child, 'inconsistent', p.child from parts e join parts p on p.parent = e.child where not exists (select 1 from parts q where q.parent = e.parent and q.child = p.child)),
r as (select *, row_number() over (partition by parent, child, kind order by n) as r, count(*) over (partition by parent, child, kind) as c from x)
select parent, child, kind, c as n, concat(string_agg(n, ', ' order by n), case when c > 6 then concat(', ... (+', c - 6, ' more)') else '' end) as names from r where r <= 6 group by parent, child, kind, c""",
)
def _(t):
    return R.node_neighbourhood(t("parts"), t("parts")).drop("graph_id")


@query("g20_concept_subgraph", ctes("parts") + "select * from parts where contains(lower(parent), 'widget') or contains(lower(child), 'widget')")
def _(t):
    return R.concept_subgraph(t("parts"), "Widget")


# Scores.
@query("m1_term_pairs", ctes("lemma_gt") + f"select distinct u as term_u, v as term_v from (select unnest({lemma_sql('parent')}) as u, {lemma_sql('child')} as l from lemma_gt), unnest(l) w(v)")
def _(t):
    return M.term_pairs(t("lemma_gt")).drop("graph_id")


def _tp(name: str, out: str) -> str:
    return f", {out} as (select distinct parent, child, u, v from (select parent, child, unnest({lemma_sql('parent')}) as u, {lemma_sql('child')} as l from {name}), unnest(l) w(v))"


@query("m2_label_edges", ctes("lemma_gt", "lemma_pred") + _tp("lemma_gt", "g") + _tp("lemma_pred", "p") + " select parent, child, cast(case when bool_or(exists (select 1 from g where g.u = p.u and g.v = p.v)) then 0 else 1 end as int) as is_fp from p group by parent, child")
def _(t):
    return M.label_edges(t("lemma_pred"), t("lemma_gt")).drop("graph_id")


_PRF = """select graph_id, tp, n_pred, covered, n_gt, round(tp / n_pred, 6) as "precision", round(covered / n_gt, 6) as recall, round(2 * (tp / n_pred) * (covered / n_gt) / (tp / n_pred + covered / n_gt), 6) as f1 from s"""


@query(
    "m3_prf",
    ctes("lemma_gt", "lemma_pred") + _tp("lemma_gt", "g") + _tp("lemma_pred", "p")
    + """, s as (select 'lemma' as graph_id, (select count(*) from (select distinct parent, child from p where exists (select 1 from g where g.u = p.u and g.v = p.v))) as tp, (select count(*) from lemma_pred) as n_pred,
(select count(*) from (select distinct parent, child from g where exists (select 1 from p where g.u = p.u and g.v = p.v))) as covered, (select count(*) from lemma_gt) as n_gt) """ + _PRF,
)
def _(t):
    return M.prf(t("lemma_pred"), t("lemma_gt")).select("graph_id", "tp", "n_pred", "covered", "n_gt", *r6("precision", "recall", "f1"))


@query("m4_match_report", ctes("parts", "parts_pred") + "select 'TP' as tag, parent, child from (select * from parts_pred intersect select * from parts) union all select 'FP', parent, child from (select * from parts_pred except select * from parts) union all select 'FN', parent, child from (select * from parts except select * from parts_pred)")
def _(t):
    return M.match_report(t("parts_pred"), t("parts")).drop("graph_id")


def _mode(mode: str, p: str, g: str) -> str:
    tp = f"(select count(*) from (select * from {p} intersect select * from {g}))"
    pr, rc = f"{tp} / (select count(*) from {p})", f"{tp} / (select count(*) from {g})"
    return f"select '{mode}' as mode, round({pr}, 6) as \"precision\", round({rc}, 6) as recall, round(2 * ({pr}) * ({rc}) / ({pr} + {rc}), 6) as f1"


_MODES = (
    _RED + ", pred_red as (select * from parts_pred p where not exists (select 1 from parts_pred q join parts_pred_c c on c.a = q.child where q.parent = p.parent and c.d = p.child)), "
    + "lp as (select distinct graph_id, lower(parent) as parent, lower(child) as child from parts_pred), lg as (select distinct graph_id, lower(parent) as parent, lower(child) as child from parts), lpc as (select distinct lower(a), lower(d) from parts_pred_c), lgc as (select distinct lower(a), lower(d) from parts_c) "
    + " union all ".join([_mode("Cond_Red", "pred_red", "red"), _mode("Cond_Clos", "parts_pred_c", "parts_c"), _mode("Exp_Raw", "lp", "lg"), _mode("Exp_Clos", "lpc", "lgc")])
)


@query("m5_evaluate_deep", ctes("deep_c", "deep_pred_c") + _MODES.replace("parts", "deep"))
def _(t):
    return M.evaluate_modes(t("deep_pred"), t("deep")).select("mode", *r6("precision", "recall", "f1"))


@query("m5_evaluate_modes", ctes("parts_c", "parts_pred_c") + _MODES)
def _(t):
    return M.evaluate_modes(t("parts_pred"), t("parts")).select("mode", *r6("precision", "recall", "f1"))


_PARTS = """, up as (select d as n, count(*) as u from parts_pred_c group by d), dn as (select a as n, count(*) as u from parts_pred_c group by a),
ag as (select e.parent, e.child, count(*) as k from parts_pred e join parts_pred_c c on c.a = e.child join parts_pred f on f.parent = e.parent and f.child = c.d group by all),
comp as (select e.graph_id, e.parent, e.child, (coalesce(up.u, 0) + 1) * (coalesce(dn.u, 0) + 1) as leverage, case when dn.u > 0 then coalesce(k, 0) / dn.u else 1.0 end as agr, cast(ascii(substr(e.child, 1, 1)) % 3 as bigint) as votes, cast(length(e.parent) as bigint) as salience
from parts_pred e left join up on up.n = e.parent left join dn on dn.n = e.child left join ag on ag.parent = e.parent and ag.child = e.child)"""
_SUS = """, f as (select *, (row_number() over (order by leverage, parent, child) - 1) / (count(*) over () - 1) as lp, (row_number() over (order by salience, parent, child) - 1) / (count(*) over () - 1) as sp from comp),
sus as (select graph_id, parent, child, leverage, lp + (1 - agr) + (case when votes <= 1 then 1.0 else 0.0 end) + (1 - sp) as score from f)"""


def _comp(t, graph: str = "parts_pred", closure: DataFrame | None = None) -> DataFrame:
    votes = t(graph).select("graph_id", "parent", "child", (F.ascii(F.substring("child", 1, 1)) % 3).alias("votes"), F.length("parent").alias("salience"))
    return M.edge_components(t(graph), votes, closure)


@query("m6_edge_components", ctes("parts_pred_c") + _PARTS + " select parent, child, leverage, round(agr, 6) as neighborhood_agreement, votes, salience from comp")
def _(t):
    return _comp(t).select("parent", "child", "leverage", *r6("neighborhood_agreement"), "votes", "salience")


@query(
    "m7_edge_votes",
    ctes("named") + """, e as (select distinct noun, name, noun like '%g%' as g from named) select case when g then name else noun end as parent, case when g then noun else name end as child, cast(1 as bigint) as votes, cast(1 as bigint) as salience from e""",
)
def _(t):
    edges, salience = P.assertions_to_edges(t("replies"), t("vocab"))
    raw = edges.select(F.col("run_id").alias("graph_id"), "parent", "child").distinct()
    final, mapping = R.condense_synonyms(raw)
    return M.edge_votes(edges, salience, mapping, t("vocab"), final).drop("graph_id")


@query("m8_suspicion", ctes("parts_pred_c") + _PARTS + _SUS + " select parent, child, round(score, 6) as score from sus")
def _(t):
    return M.suspicion(_comp(t)).select("parent", "child", *r6("score"))


@query("m9_top_k_suspects", ctes("parts_pred_c") + _PARTS + _SUS + ", q as (select parent, child, row_number() over (order by score desc, parent, child) as r from sus) select parent, child, cast(r as int) as rank, case when r <= 20 then 'SUSPECT' else 'keep' end as mark from q")
def _(t):
    return M.top_k_suspects(M.suspicion(_comp(t)), 20).select("parent", "child", "rank", "mark")


@query("m10_leverage_candidates", ctes("parts_pred_c", "parts_c") + _PARTS + ", q as (select parent, child, leverage, row_number() over (order by leverage desc, parent, child) as r from comp where (parent, child) not in (select a, d from parts_c)) select parent, child, leverage, cast(r as int) as rank from q where r <= 15")
def _(t):
    return M.leverage_candidates(t("parts_pred"), R.transitive_closure(t("parts"))).drop("graph_id")


_WRONG = ", wrong as (select parent, child from parts_pred where (parent, child) not in (select a, d from parts_c))"
_STAR = ", star as (select a, d from parts_pred_c union select parent, parent from parts_pred union select child, child from parts_pred)"


@query(
    "m11_remove_edges",
    ctes("parts_pred_c", "parts_c") + _WRONG + _STAR + """, gone as (select distinct e.parent, e.child from wrong w join star s on s.a = w.parent join parts_pred e on e.parent = s.d join star z on z.a = e.child and z.d = w.child)
select parent, child from parts_pred where (parent, child) not in (select parent, child from gone)""",
)
def _(t):
    e = t("parts_pred")
    wrong = M.label_edges(e, M.as_edges(R.transitive_closure(t("parts"))), "exact").where("is_fp = 1")
    return M.remove_edges(e, wrong).drop("graph_id")


@query(
    "m12_apply_verdicts",
    ctes("parts_pred_c") + _PARTS + _SUS + """, q as (select parent, child, row_number() over (order by score desc, parent, child) as r from sus)
select cast(k as int) as k, parent, child from q, (select unnest([0, 1, 3, 10, 25]) as k) where not (r <= k and length(child) % 2 = 0)""",
)
def _(t):
    ranked = M.top_k_suspects(M.suspicion(_comp(t)), 0)
    verdicts = t("parts_pred").withColumn("sever", F.length("child") % 2 == 0)
    return M.apply_verdicts(t("parts_pred"), ranked, verdicts, KS).drop("graph_id")


@query(
    "m13_rebuild_from_rewrite",
    ctes("parts_pred", "parts_other") + "select parent, child from parts_pred where (parent, child) in (select parent, child from parts_other) or not (length(child) > 9)",
)
def _(t):
    return M.rebuild_from_rewrite(t("parts_pred"), t("parts_other"), t("parts_pred").where(F.length("child") > 9)).drop("graph_id")


@query(
    "m13_rebuild_whole",
    ctes("ring_c") + _SCC + _ROOTS.format("ring") + """, k as (select node, scc, coalesce(depth, 1 << 30) as dd from scc left join dep using (node))
select parent, child from ring join k p on p.node = parent join k c on c.node = child where parent <> child and (p.scc <> c.scc or (p.dd, p.node) < (c.dd, c.node))""",
)
def _(t):
    return M.rebuild_from_rewrite(t("ring").where("parent > child"), t("ring")).drop("graph_id")


def _scores(t) -> DataFrame:
    return M.ranker_scores(_comp(t))


_DIRECT = """, rk as (select 'combined' as ranker, parent, child, row_number() over (order by score desc, parent, child) as r from sus
union all select 'leverage', parent, child, row_number() over (order by lp desc, parent, child) from f union all select 'neighborhood', parent, child, row_number() over (order by 1 - agr desc, parent, child) from f
union all select 'self_agreement', parent, child, row_number() over (order by case when votes <= 1 then 1 else 0 end desc, parent, child) from f union all select 'salience', parent, child, row_number() over (order by 1 - sp desc, parent, child) from f
union all select 'oracle', parent, child, row_number() over (order by leverage desc, parent, child) from comp where (parent, child) not in (select parent, child from parts)),
ks as (select ranker, k from (select distinct ranker from rk), (select unnest([0, 1, 3, 10, 25]) as k)),
kept as (select ks.ranker, ks.k, e.parent, e.child from ks, parts_pred e where not exists (select 1 from rk where rk.ranker = ks.ranker and rk.r <= ks.k and rk.parent = e.parent and rk.child = e.child)),
s as (select ranker, k, count(*) filter ((parent, child) in (select parent, child from parts)) as tp, count(*) as n_pred from kept group by all union all select 'baseline', 0, count(*) filter ((parent, child) in (select parent, child from parts)), count(*) from parts_pred)"""


@query("m14_prune_sweep_direct", ctes("parts_pred_c", "parts") + _PARTS + _SUS + _DIRECT + " select ranker, cast(k as int) as k, tp, n_pred, round(tp / n_pred, 6) as \"precision\", round(tp / (select count(*) from parts), 6) as recall from s")
def _(t):
    out = M.prune_sweep(t("parts_pred"), _scores(t), t("parts"), KS, closure_safe=False, use_closure=False)
    return out.select("ranker", "k", "tp", "n_pred", *r6("precision", "recall"))


_CLOSED = """, star as (select a, d from parts_pred_c union select parent, parent from parts_pred union select child, child from parts_pred),
hit as (select ranker, e.parent, e.child, min(rk.r) as gone from rk join star s1 on s1.a = rk.parent join parts_pred e on e.parent = s1.d join star s2 on s2.a = e.child and s2.d = rk.child group by all),
kept as (select ks.ranker, ks.k, e.parent, e.child from ks cross join parts_pred e left join hit h on h.ranker = ks.ranker and h.parent = e.parent and h.child = e.child where h.gone is null or h.gone > ks.k
union all select 'baseline', 0, parent, child from parts_pred),
clo(ranker, k, a, d) as (select ranker, k, parent, child from kept union select c.ranker, c.k, c.a, e.child from clo c join kept e on e.ranker = c.ranker and e.k = c.k and e.parent = c.d),
s as (select ranker, k, count(*) filter ((a, d) in (select a, d from parts_c)) as tp, count(*) as n_pred from clo group by ranker, k),
fin as (select ranker, k, tp, n_pred, tp / n_pred as p, tp / (select count(*) from parts_c) as r from s)"""
_RANKED = _DIRECT[: _DIRECT.index("kept as (")].rstrip().rstrip(",").replace("not in (select parent, child from parts)", "not in (select a, d from parts_c)")


@query("m14_prune_sweep_closure", ctes("parts_pred_c", "parts_c") + _PARTS + _SUS + _RANKED + _CLOSED + ' select ranker, cast(k as int) as k, tp, n_pred, round(p, 6) as "precision", round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1 from fin')
def _(t):
    return M.prune_sweep(t("parts_pred"), _scores(t), t("parts"), KS).select("ranker", "k", "tp", "n_pred", *r6("precision", "recall", "f1"))


@query("m14_prune_sweep_deep", ctes("deep_pred_c", "deep_c") + (_PARTS + _SUS + _RANKED + _CLOSED).replace("parts", "deep") + ' select ranker, cast(k as int) as k, tp, n_pred, round(p, 6) as "precision", round(r, 6) as recall from fin')
def _(t):
    closure = M.paths(t("deep_pred"), t("deep")) or written(R.transitive_closure(t("deep_pred")).drop("hops"), "deep-closure")
    return M.prune_sweep(t("deep_pred"), M.ranker_scores(_comp(t, "deep_pred", closure)), t("deep"), KS, closure=closure).select("ranker", "k", "tp", "n_pred", *r6("precision", "recall"))


_BAD = """, rk as (select 'oracle' as ranker, parent, child, row_number() over (order by leverage desc, parent, child) as r from comp where (parent, child) not in (select a, d from parts_c)), ks as (select 'oracle' as ranker, unnest(range(0, (select count(*) + 1 from rk))) as k)"""


@query("m15_fp_mass_curve", ctes("parts_pred_c", "parts_c") + _PARTS + _BAD + _CLOSED + """ select cast(k as int) as n, round(k / (select count(*) from rk), 6) as share_removed,
round(1 - (n_pred - tp) / (select n_pred - tp from fin where ranker = 'oracle' and k = 0), 6) as share_gone from fin where ranker = 'oracle'""")
def _(t):
    return M.fp_mass_curve(t("parts_pred"), t("parts")).select("n", *r6("share_removed", "share_gone"))


_VIEWS = _RED + ", rh(a, d, h) as (select parent, child, 1 from red union select rh.a, e.child, rh.h + 1 from rh join red e on e.parent = rh.d), vw as (select a, d, case when (a, d) in (select parent, child from red) then 'reduction' else 'implied' end as kind, min(h) as hops, (a, d) in (select a, d from parts_pred_c) as hit from rh group by a, d)"


def _recovered(t) -> DataFrame:
    return R.transitive_closure(t("parts_pred"))


@query("m16_recall_by_bucket", ctes("parts_c", "parts_pred_c") + _VIEWS + """ select count(*) filter (kind = 'reduction') as n_reduction, count(*) filter (kind = 'implied') as n_implied, count(*) as n_closure,
round(avg(hit::int) filter (kind = 'reduction'), 6) as recall_reduction, round(avg(hit::int) filter (kind = 'implied'), 6) as recall_implied, round(avg(hit::int), 6) as recall_closure from vw""")
def _(t):
    return M.recall_by_bucket(M.gt_views(t("parts")), _recovered(t)).select("n_reduction", "n_implied", "n_closure", *r6("recall_reduction", "recall_implied", "recall_closure"))


@query("m17_recall_by_hop", ctes("parts_c", "parts_pred_c") + _VIEWS + " select cast(hops as int) as hops, count(*) as support, count(*) filter (hit) as recovered, round(count(*) filter (hit) / count(*), 6) as recall, case when hops = 1 then 'direct' else 'indirect' end as kind, '0-150' as size from vw group by hops")
def _(t):
    n = R.nodes_of(t("parts")).groupBy("graph_id").agg(F.count("*").alias("nodes"))
    return M.recall_by_hop(M.gt_views(t("parts")), _recovered(t), n).select("hops", "support", "recovered", *r6("recall"), "kind", "size")


_NODE = """, hit as (select a, d, (a, d) in (select a, d from parts_pred_c) as h from parts_c), gi as (select n, count(*) as gt_incident, count(*) filter (h) as gt_recovered from (select a as n, h from hit union all select d, h from hit) group by n),
pl as (select a, d, (a, d) in (select a, d from parts_c) as ok from parts_pred_c), pi as (select n, count(*) as pred_incident, count(*) filter (ok) as pred_correct from (select a as n, ok from pl union all select d, ok from pl) group by n),
dp as (select d as n, count(*) as node_depth from parts_c group by d), st as (select coalesce(gi.n, pi.n) as node, 1 as syn_count, coalesce(node_depth, 0) as node_depth, coalesce(gt_incident, 0) as gt_incident, coalesce(gt_recovered, 0) as gt_recovered,
coalesce(pred_incident, 0) as pred_incident, coalesce(pred_correct, 0) as pred_correct from gi full join pi on gi.n = pi.n left join dp on dp.n = coalesce(gi.n, pi.n))"""


def _stats(t) -> DataFrame:
    gt, pred = R.transitive_closure(t("parts")), R.transitive_closure(t("parts_pred"))
    labelled = M.label_edges(M.as_edges(pred), M.as_edges(gt), "exact").select("graph_id", F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), "is_fp")
    return M.node_synonym_stats(gt, pred, labelled)


@query("m18_node_synonym_stats", ctes("parts_c", "parts_pred_c") + _NODE + " select node, cast(syn_count as int) as syn_count, node_depth, gt_incident, gt_recovered, round(gt_recovered / gt_incident, 6) as node_recall, pred_incident, cast(pred_correct as bigint) as pred_correct, round(pred_correct / pred_incident, 6) as node_precision from st")
def _(t):
    return _stats(t).select("node", "syn_count", "node_depth", "gt_incident", "gt_recovered", *r6("node_recall"), "pred_incident", "pred_correct", *r6("node_precision"))


def _lengthy(t) -> DataFrame:
    # Names of one form only: take the number of words for the number of forms.
    return _stats(t).withColumn("syn_count", F.size(F.split("node", " ")))


_CURVE = _NODE + """, sc as (select *, len(string_split(node, ' ')) as k from st), cv as (select k, count(*) as n_nodes, sum(gt_incident)::bigint as gi, sum(gt_recovered)::bigint as gr, sum(pred_incident)::bigint as pi, sum(pred_correct)::bigint as pc from sc group by k),
cr as (select k, n_nodes, gr / nullif(gi, 0) as r, pc / nullif(pi, 0) as p, gi, pi from cv)"""


@query("m19_synonym_curve", ctes("parts_c", "parts_pred_c") + _CURVE + """ select 'parts' as graph_id, cast(k as int) as syn_count, n_nodes, round(p, 6) as "precision", round(r, 6) as recall, round(2 * p * r / nullif(p + r, 0), 6) as f1 from cr union all select null, cast(k as int), n_nodes, round(p, 6), round(r, 6), round(2 * p * r / nullif(p + r, 0), 6) from cr""")
def _(t):
    return M.synonym_curve(_lengthy(t)).select("graph_id", "syn_count", "n_nodes", *r6("precision", "recall", "f1"))


@query("m19_synonym_optimum", ctes("parts_c", "parts_pred_c") + _CURVE + """ select cast(k as int) as best_syn_count, round(p, 6) as "precision", round(r, 6) as recall, round(2 * p * r / (p + r), 6) as f1 from cr where gi >= 20 and pi >= 20 and p + r > 0 order by 2 * p * r / (p + r) desc, k limit 1""")
def _(t):
    return M.synonym_optimum(M.synonym_curve(_lengthy(t))).select("best_syn_count", *r6("precision", "recall", "f1"))


@query(
    "m19_synonym_lift",
    ctes("parts_c", "parts_pred_c") + _CURVE + """, rk as (select gt_recovered / nullif(gt_incident, 0) as nr, rank() over (order by k) + (count(*) over (partition by k) - 1) / 2.0 as a from sc), rr as (select a, rank() over (order by nr) + (count(*) over (partition by nr) - 1) / 2.0 as b from rk where nr is not null)
select count(*) as n_nodes, count(*) filter (k >= 2) as n_multi, round(sum(gt_recovered) filter (k < 2) / sum(gt_incident) filter (k < 2), 6) as recall_single, round(sum(gt_recovered) filter (k >= 2) / sum(gt_incident) filter (k >= 2), 6) as recall_multi,
round((select corr(a, b) from rr), 6) as spearman_recall from sc""",
)
def _(t):
    return M.synonym_lift(_lengthy(t)).select("n_nodes", "n_multi", *r6("recall_single", "recall_multi", "spearman_recall"))


_MISS = ", ms as (select parent, child from parts where (parent, child) not in (select a, d from parts_pred_c))"


@query(
    "m20_coverage",
    ctes("parts", "parts_pred_c") + _MISS + """ select count(*) as gt_edges, count(*) - (select count(*) from ms) as gt_recovered, (select count(*) from (select parent from parts union select child from parts)) as nodes,
(select count(*) from (select parent from parts_pred union select child from parts_pred)) as nodes_touched, round((count(*) - (select count(*) from ms)) / count(*), 6) as recall from parts""",
)
def _(t):
    return M.coverage_and_misses(t("parts_pred"), t("parts"))[0].select("gt_edges", "gt_recovered", "nodes", "nodes_touched", *r6("recall"))


@query(
    "m20_misses",
    ctes("parts", "parts_pred_c") + _MISS + _ROOTS.format("parts") + """, od as (select parent as n, count(*) as o from parts group by parent) select cast(least(coalesce(depth, -1), 6) as int) as parent_depth, count(*) as missed, count(*) filter (child not in (select parent from parts)) as leaf_child,
count(*) filter (o >= 5) as hub_parent from ms left join dep on dep.node = parent join od on od.n = parent group by 1""",
)
def _(t):
    return M.coverage_and_misses(t("parts_pred"), t("parts"))[1].drop("graph_id")


_VD = ", la as (select parent, child, (parent, child) not in (select parent, child from parts) as fp from parts_pred), lb as (select parent, child, (parent, child) not in (select parent, child from parts) as fp from parts_other)"


@query(
    "m21_variant_diff",
    ctes("parts", "parts_pred_c", "parts_other") + _VD + _MISS + """ select parent, child, 'only_a' as present_in, cast(fp as int) as is_fp from la where (parent, child) not in (select parent, child from lb) union all select parent, child, 'only_b', cast(fp as int) from lb where (parent, child) not in (select parent, child from la)
union all select parent, child, 'gt_and_b', 0 from ms where (parent, child) in (select parent, child from lb)""",
)
def _(t):
    a, b = (M.label_edges(t(x), t("parts"), "exact") for x in ("parts_pred", "parts_other"))
    return M.variant_diff(a, b, t("parts"))[1].drop("graph_id")


@query(
    "m21_variant_summary",
    ctes("parts", "parts_pred", "parts_other") + _VD + """, j as (select la.fp as a, lb.fp as b, la.parent is not null as ha, lb.parent is not null as hb from la full join lb on la.parent = lb.parent and la.child = lb.child)
select count(*) filter (not hb) as only_a, count(*) filter (not ha) as only_b, count(*) filter (ha and hb) as "both", count(*) filter (not hb and a) as only_a_fp, count(*) filter (not ha and b) as only_b_fp, count(*) filter (ha and hb and a) as both_fp from j""",
)
def _(t):
    a, b = (M.label_edges(t(x), t("parts"), "exact") for x in ("parts_pred", "parts_other"))
    return M.variant_diff(a, b, t("parts"))[0].select("only_a", "only_b", "both", "only_a_fp", "only_b_fp", "both_fp")


@query(
    "m22_fp_context",
    ctes("parts_c", "parts_pred") + """, fp as (select parent, child from parts_pred except select parent, child from parts), lc as (select distinct lower(a) as a, lower(d) as d from parts_c) select parent, child,
coalesce((select array_to_string(list_sort(list(a))[1:8], ', ') from lc where d = lower(child)), '') as child_is_a, coalesce((select array_to_string(list_sort(list(a))[1:8], ', ') from lc where d = lower(parent)), '') as parent_is_a,
coalesce((select array_to_string(list_sort(list(d))[1:8], ', ') from lc where a = lower(parent)), '') as parent_contains from fp""",
)
def _(t):
    fps = M.label_edges(t("parts_pred"), t("parts"), "exact").where("is_fp = 1")
    return M.fp_context(fps, M.term_pairs(M.as_edges(R.transitive_closure(t("parts"))))).drop("graph_id")


@query("m23_fp_reason_distribution", ctes("reasons") + """, n as (select graph_id, bucket, count(*) as n from reasons group by all union all select 'OVERALL', bucket, count(*) from reasons group by bucket)
select graph_id, bucket, n, round(n / sum(n) over (partition by graph_id), 6) as share, first_value(bucket) over (partition by graph_id order by n desc, bucket) as majority from n""")
def _(t):
    return M.fp_reason_distribution(t("reasons")).select("graph_id", "bucket", "n", *r6("share"), "majority")


@query("m23_fp_sample", ctes("diag") + ", f as (select distinct graph_id, parent, child from diag where is_fp = 1), r as (select *, row_number() over (partition by graph_id order by md5(concat('42:', parent, ':', child)), parent, child) as r from f) select graph_id, parent, child from r where r <= 60")
def _(t):
    return M.fp_sample(t("diag").where("is_fp = 1"))


@query("m24_hearst_ppl", """with e as (select concat('l', label) as graph_id, vec_id, list_transform(embedding, lambda x: -abs(x::double)) as v from embeddings), r as (select *, row_number() over (partition by graph_id order by md5(concat('42:', 'p:c', vec_id)), concat('c', vec_id)) as r from e)
select graph_id, round(avg(exp(-list_avg(v[1:63]))), 4) as hearst_ppl from r where r <= 100 group by graph_id""")
def _(t):
    e = t("embeddings").select(F.concat(F.lit("l"), F.col("label").cast("string")).alias("graph_id"), F.lit("p").alias("parent"), F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("child"), F.transform("embedding", lambda x: -F.abs(x.cast("double"))).alias("logprobs"))
    return M.hearst_ppl(e).select("graph_id", F.round("hearst_ppl", 4).alias("hearst_ppl"))


_PROFILE = """, dg as (select node, sum(i) as i, sum(o) as o from (select child as node, 1 as i, 0 as o from {0} union all select parent, 0, 1 from {0}) group by node), roots as (select node from dg where i = 0), b(node, h) as (select node, 0 from roots union select e.child, b.h + 1 from b join {0} e on e.parent = b.node)
select count(*) as nodes, (select count(*) from {0}) as edges, count(*) filter (i = 0) as roots, count(*) filter (o = 0) as leaves, round((select count(*) from {0}) / count(*), 3) as edge_node_ratio, cast((select max(h) from b) as int) as max_depth,
round(avg(o) filter (o > 0), 2) as avg_branching, round(avg((i = 1)::int) filter (i > 0), 3) as tree_likeness, round((select count(*) filter (contains(parent, child) or contains(child, parent)) / count(*) from {0}), 3) as lexical_overlap,
round((select count(*) from {0}) / (select count(*) from {0}_c), 4) as redundancy_ratio from dg"""


_WHOLE = (_WEAK + ", lg as (select exp((length(parent) + length(child)) / 20.0) as p, row_number() over (order by md5(concat('42:', parent, ':', child)), parent, child) as r from {0})" + _PROFILE).removesuffix(" from dg") + ", (select count(distinct component) from wk) as components, (select round(avg(p), 2) from lg where r <= 100) as hearst_ppl from dg"


def _profile(t, graph: str) -> DataFrame:
    own = lambda c: (-F.length(c) / 10.0).cast("double")
    ppl = M.hearst_ppl(t(graph).withColumn("logprobs", F.array(own("parent"), own("child"), F.lit(0.0))))
    return M.graph_profile(t(graph), ppl).drop("graph_id")


@query("m25_graph_profile", ctes("parts_c") + _WHOLE.format("parts"))
def _(t):
    return _profile(t, "parts")


@query("m25_profile_deep", ctes("deep_c") + _WHOLE.format("deep"))
def _(t):
    return _profile(t, "deep")


# Fine-tuning data.
@query("f1_holdout_pairs", ctes("parts", "parts_other_c") + ", ev as (select parent as n from parts_other union select child from parts_other) select 'kept' as what, parent, child from parts where (parent, child) not in (select a, d from parts_other_c)")
def _(t):
    kept, _ = N.holdout_pairs(t("parts"), t("parts_other"), node_disjoint=False)
    return kept.select(F.lit("kept").alias("what"), "parent", "child")


@query("f1_holdout_stats", ctes("parts", "geo") + ", held as (select p_brand as n from part), e as (select * from parts where parent not in (select n from held) and child not in (select n from held)) select (select count(*) from parts) as pool_edges, count(*) as after_node_disjoint, count(*) as kept, (select count(*) from parts) - count(*) as dropped_node_overlap, cast(0 as bigint) as dropped_closure_leak from e")
def _(t):
    held = t("part").select(F.lit("parts").alias("graph_id"), F.lit("brands").alias("parent"), F.col("p_brand").alias("child"))
    return N.holdout_pairs(t("parts"), held)[1].select("pool_edges", "after_node_disjoint", "kept", "dropped_node_overlap", "dropped_closure_leak")


@query(
    "f2_leakage_report",
    ctes("parts", "parts_other_c") + """, ev as (select distinct lower(n) as n from (select parent as n from parts_other union select child from parts_other)), tr as (select distinct lower(n) as n from (select parent as n from parts union select child from parts))
select (select count(*) from parts where (parent, child) in (select a, d from parts_other_c)) as violations, count(*) as eval_terms, count(*) filter (n in (select n from tr)) as shared_terms, round(count(*) filter (n in (select n from tr)) / count(*), 6) as node_overlap from ev""",
)
def _(t):
    return N.leakage_report(t("parts"), t("parts_other")).select("violations", "eval_terms", "shared_terms", *r6("node_overlap"))


@query("f3_make_examples", ctes("parts_c") + """, n as (select parent as node from parts union select child from parts), l as (select d as t, concat(lower(d), ' <= ', lower(a)) as l from parts_c union select a, concat(lower(d), ' <= ', lower(a)) from parts_c)
select lower(node) as target, coalesce((select string_agg(l, ';' order by l) from l where t = node), 'none') as completion, cast((select count(*) - 1 from n) as int) as n_candidates from n""")
def _(t):
    out = N.make_examples(t("parts"), 5000)
    return out.select("target", F.array_join(F.array_sort(F.split("completion", "\n")), ";").alias("completion"), F.size("candidates").alias("n_candidates"))


_PROMPT = """Which of the candidates C are above or below '{t}' in an is-a hierarchy?
- Where everything called '{t}' may also be called C, write {t} <= C.
- Where everything called C may also be called '{t}', write C <= {t}.
Relate candidates to '{t}' only, not to each other.
One relation a line; 'none' if there is none.
Example: owl <= bird
Candidates:
""".replace("'", "''")


@query("f4_render_prompts", ctes("named") + f", s as (select noun, list(distinct name order by name) as c from named group by noun) select 'named' as domain, concat(replace('{_PROMPT}', '{{t}}', noun), array_to_string(list_transform(c, lambda x: concat('- ', x)), chr(10))) as prompt, case when len(c) > 1 then concat(c[1], ' <= ', noun) else 'none' end as completion from s")
def _(t):
    s = t("named").groupBy("noun").agg(F.array_sort(F.collect_set("name")).alias("candidates"))
    first = F.when(F.size("candidates") > 1, F.concat(F.get("candidates", F.lit(0)), F.lit(" <= "), "noun")).otherwise("none")
    return N.render_prompts(s.select(F.lit("named").alias("graph_id"), F.col("noun").alias("target"), "candidates", first.alias("completion")), "full")


@query("f4_prompts_of_examples")
def _(t):
    return N.render_prompts(N.make_examples(t("parts"), 20), "full")


@query(
    "f5_sft_manifest",
    """with s as (select source as domain, lang, doc_id, case when n_chars % 3 = 0 then 'none' else lang end as c, len(list_filter(regexp_split_to_array(concat_ws(' ', text, case when n_chars % 3 = 0 then 'none' else lang end), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) as w from documents where source is not null)
select domain, count(*) as examples, count(*) filter (c <> 'none') as with_relations, median(w) as median_words, cast(max(w) as int) as max_words, round(avg((w > 300)::int), 6) as over_cap, count(*) as train_pairs from s group by domain""",
)
def _(t):
    d = t("documents").where("source is not null")
    sft = d.select(F.col("source").alias("domain"), F.col("text").alias("prompt"), F.when(F.col("n_chars") % 3 == 0, "none").otherwise(F.col("lang")).alias("completion"))
    pairs = d.select(F.col("source").alias("graph_id"), F.col("lang").alias("parent"), F.col("doc_id").cast("string").alias("child"))
    return N.sft_manifest(sft, pairs, 300).select("domain", "examples", "with_relations", "median_words", "max_words", *r6("over_cap"), "train_pairs")


@query("f5_sft_manifest_examples")
def _(t):
    e = t("parts").union(t("geo"))
    return N.sft_manifest(N.render_prompts(N.make_examples(e, 20)), e)


# Result tables.
@query("a1_upsert_results", ctes("runs") + "select dataset, method, use_synsets, explode_nodes, case when ordinal % 2 = 0 then f1 + 1 else f1 end as f1, model from runs")
def _(t):
    store = t("runs").select("dataset", "use_synsets", "explode_nodes", "method", "f1", "model")
    new = t("runs").where("ordinal % 2 = 0").select("dataset", "use_synsets", "explode_nodes", "method", (F.col("f1") + 1).alias("f1"))
    return A.upsert_results(store, new)


@query("a2_merge_with_profile", ctes("runs", "profile") + "select dataset, method, f1, nodes, concat(dataset, case when use_synsets then ' (Syn)' else '' end) as scenario from runs join profile using (dataset)")
def _(t):
    runs = t("runs").withColumn("dataset", F.concat("dataset", F.lit(".csv")))
    return A.merge_with_profile(runs, t("profile"))[0].select("dataset", "method", "f1", "nodes", "scenario")


@query("a3_method_by_scenario", ctes("runs") + """, w as (select method, avg(f1) filter (use_synsets) as s, avg(f1) filter (not use_synsets) as p from runs group by method) select method, round(p, 12) as plain, round(s, 12) as syn, round((coalesce(s, 0) + coalesce(p, 0)) / nullif((s is not null)::int + (p is not null)::int, 0), 12) as row_mean from w""")
def _(t):
    runs = t("runs").withColumn("scenario", F.when(F.col("use_synsets"), "syn").otherwise("plain"))
    return A.method_by_scenario(runs, "f1", ["plain", "syn"]).select("method", *r12("plain", "syn", "row_mean"))


@query("a4_method_variance", ctes("runs") + "select method, count(f1) as n, round(avg(f1), 12) as mean, round(var_samp(f1), 12) as variance, round(stddev_samp(f1), 12) as sd, min(f1) as low, max(f1) as high, round(median(f1), 12) as median from runs group by method")
def _(t):
    return A.method_variance(t("runs"), "f1").select("method", "n", *r12("mean", "variance", "sd"), "low", "high", *r12("median"))


@query("a5_best_per_scenario", ctes("runs") + ", r as (select *, row_number() over (partition by dataset order by f1 desc, method) as r from runs) select dataset, method, f1 from r where r = 1")
def _(t):
    return A.best_per_scenario(t("runs"), "f1", "dataset").select("dataset", "method", "f1")


@query("a6_spearman_by_method", ctes("runs", "profile") + """, x as (select method, f1 as y, unnest([{'m': 'nodes', 'x': nodes::double}, {'m': 'depth', 'x': depth}]) as v from runs join profile using (dataset)), z as (select method, v.m as metric, v.x as x, y from x),
r as (select method, metric, rank() over (partition by method, metric order by x) + (count(*) over (partition by method, metric, x) - 1) / 2.0 as a, rank() over (partition by method, metric order by y) + (count(*) over (partition by method, metric, y) - 1) / 2.0 as b from z)
select method, metric, count(*) as n, round(corr(a, b), 6) as rho from r group by all having count(*) > 2""")
def _(t):
    runs = t("runs").join(t("profile"), "dataset")
    return A.spearman_by_method(runs, "f1", ["nodes", "depth"]).select("method", "metric", "n", *r6("rho"))


@query("a7_runtime_scaling", ctes("runs", "profile") + r""", m as (select trim(regexp_replace(method, '\s*\(.*\)\s*', '')) as method, dataset, nodes, median(runtime) as t from runs join profile using (dataset) group by all)
select method, count(*) as n, round(regr_slope(log10(t), log10(nodes::double)), 6) as slope, round(regr_intercept(log10(t), log10(nodes::double)), 6) as intercept from m group by method""")
def _(t):
    return A.runtime_scaling(t("runs").join(t("profile"), "dataset")).select("method", "n", *r6("slope", "intercept"))


@query("a8_melt_metrics", ctes("runs") + "select method, 'f1' as type, count(f1) as n, round(avg(f1), 12) as mean from runs group by method union all select method, 'runtime', count(runtime), round(avg(runtime), 12) from runs group by method")
def _(t):
    return A.melt_metrics(t("runs"), ["f1", "runtime"], ["method"]).select("method", "type", "n", *r12("mean"))


@query("a9_paired_delta_test", ctes("runs") + r""", m as (select dataset, concat('k', regexp_extract(method, 'clawback=([0-9]+)', 1)) as c, avg(f1) as m from runs group by all), d as (select a.c as category, a.m - b.m as d from m a join m b on a.dataset = b.dataset and b.c = 'k0' where a.c <> 'k0')
select category, count(*) as n, round(avg(d), 6) as mean_delta, round(avg(d) / sqrt(var_samp(d) / count(*)), 6) as t, count(*) - 1 as df from d group by category having count(*) > 1""")
def _(t):
    runs = t("runs").withColumn("category", F.concat(F.lit("k"), T.parse_label("method")["clawback"].cast("string")))
    return A.paired_delta_test(runs, "category", "f1", "k0").where("n > 1").select("category", "n", *r6("mean_delta", "t"), "df")


@query("a10_model_gap", ctes("runs") + """, a as (select dataset, max(f1) as f from runs where model = 'm0' group by 1), b as (select dataset, max(f1) as f from runs where model = 'm1' group by 1) select coalesce(a.dataset, b.dataset) as dataset, case when a.f is null then 'only_b' when b.f is null then 'only_a' else 'shared' end as side,
round(a.f - b.f, 12) as gap, case when a.f > b.f then 'a' when a.f < b.f then 'b' when a.f = b.f then 'tie' end as winner from a full join b on a.dataset = b.dataset""")
def _(t):
    one = lambda m: t("runs").where(F.col("model") == m).groupBy("dataset").agg(F.max("f1").alias("f1"))
    return A.model_gap(one("m0"), one("m1"), "f1").select("dataset", "side", *r12("gap"), "winner")


@query("a11_last_run", ctes("runs") + ", r as (select dataset, model, ordinal, method, f1, row_number() over (partition by dataset order by ordinal * 1000 + ascii(substr(method, 13, 1)) * 10 + length(method) desc, method) as r from runs), o as (select dataset, max(ordinal) as ordinal from runs group by dataset) select dataset, ordinal from o")
def _(t):
    return A.last_run_per_dataset(t("runs"), ("dataset",)).select("dataset", "ordinal")


@query("a11_mixed_models", ctes("runs") + "select dataset, count(distinct model) as n_models from runs group by dataset having count(distinct model) > 1")
def _(t):
    return A.mixed_models(t("runs"), "dataset")


@query("a12_pruned_run_means", ctes("runs") + "select cast(ordinal % 4 as int) as k, 'leverage' as rank_by, count(*) as n, round(avg(f1), 12) as f1 from runs where ordinal % 7 > 0 group by 1")
def _(t):
    label = F.concat(F.lit("X+restructure_prune_only_top"), (F.col("ordinal") % 4).cast("string"), F.lit(" (+rank_leverage)"))
    return A.pruned_run_means(t("runs").withColumn("method", label).withColumn("f1", F.when(F.col("ordinal") % 7 > 0, F.col("f1"))), ("f1",)).select("k", "rank_by", "n", *r12("f1"))


@query("a13_clawback_curve", ctes("runs") + """, m as (select dataset, cast(regexp_extract(method, 'clawback=([0-9]+)', 1) as int) as k, avg(f1) as v from runs group by all)
select dataset, k as clawback, round(v, 12) as value, round(max(v) filter (k = 0) over (partition by dataset), 12) as baseline, cast(first_value(k) over (partition by dataset order by v desc, k) as int) as peak_clawback from m""")
def _(t):
    return A.clawback_curve(t("runs"), "f1", "dataset").select("dataset", "clawback", *r12("value", "baseline"), "peak_clawback")


@query("a14_heuristic_informativeness", ctes("diag") + """, q as (select avg(is_fp) as b, corr(leverage, is_fp) as r, list_distinct([quantile_cont(leverage, 0.2), quantile_cont(leverage, 0.4), quantile_cont(leverage, 0.6), quantile_cont(leverage, 0.8)]) as q from diag)
select cast(len(list_filter(q, lambda e: e < leverage)) as double) as bin, round(any_value(b), 6) as baseline, round(any_value(r), 6) as r, count(*) as support, round(avg(is_fp), 6) as fp_rate from diag, q group by 1""")
def _(t):
    return A.heuristic_informativeness(t("diag"), "leverage").select("bin", *r6("baseline", "r"), "support", *r6("fp_rate"))


@query("a15_scale_retention")
def _(t):
    runs = t("runs").withColumn("method", F.regexp_extract("method", r"\[(.)\]", 1))
    return A.scale_retention(runs, "f1").select("dataset", "method", *r12("sub", "full", "retention"))


ORACLE_SQL["a15_scale_retention"] = ctes("runs") + r""", m as (select regexp_extract(dataset, '^(.*)_(SUB|FULL)$', 1) as d, regexp_extract(method, '\[(.)\]', 1) as method, avg(f1) filter (ends_with(dataset, '_SUB')) as s, avg(f1) filter (ends_with(dataset, '_FULL')) as f from runs group by 1, 2)
select d as dataset, method, round(s, 12) as sub, round(f, 12) as "full", round(f / nullif(s, 0), 12) as retention from m where s is not null and f is not null"""


@query("a16_roc_auc", ctes("diag") + """, r as (select graph_id, is_fp, rank() over (partition by graph_id order by leverage) + (count(*) over (partition by graph_id, leverage) - 1) / 2.0 as r, count(*) filter (is_fp = 1) over (partition by graph_id) as p, count(*) filter (is_fp = 0) over (partition by graph_id) as n from diag)
select graph_id, round((sum(r) - any_value(p) * (any_value(p) + 1) / 2.0) / (any_value(p) * any_value(n)), 6) as auc from r where is_fp = 1 group by graph_id""")
def _(t):
    return A.roc_auc(t("diag"), "leverage", "is_fp").select("graph_id", *r6("auc"))


@query("a17_learned_suspicion")
def _(t):
    return A.learned_suspicion(M.suspicion_features(t("diag"), keep=("is_fp",)), ["f_leverage", "f_neighborhood", "f_self_agreement", "f_salience"]).select("graph_id", "parent", "child", F.round("p_fp", 3).alias("p_fp"))


# At its solution a fold's mean probability over the rows it learns from is their share of false positives.
@query("a17_fold_balance", ctes("diag") + """, s as (select graph_id, sum(is_fp) as f, count(*) as n from diag group by graph_id)
select graph_id, round(((select sum(f) from s) - f) / ((select sum(n) from s) - n), 6) as mean_p from s union all select null, round(sum(f) / sum(n), 6) from s""")
def _(t):
    names = ["f_leverage", "f_neighborhood", "f_self_agreement", "f_salience"]
    x = M.suspicion_features(t("diag"), keep=("is_fp",))
    folds = A.logistic_folds(x, names).withColumnRenamed("graph_id", "_fold")
    met = x.join(F.broadcast(folds), (F.col("_fold").isNull()) | (F.col("graph_id") != F.col("_fold")))
    return met.groupBy(F.col("_fold").alias("graph_id")).agg(F.round(F.avg(A.logistic(names, "weights")), 6).alias("mean_p"))


@query("a18_perplexity_features", ctes("ppl") + """, e as (select 'x' as graph_id, r_name as parent, n_name as child from region join nation on r_regionkey = n_regionkey union select 'x', parent, child from ppl), j as (select e.*, a.ppl as f, a.ppl / nullif(b.ppl, 0) as q from e left join ppl a on a.child = e.child and a.parent = e.parent left join ppl b on b.child = e.parent and b.parent = e.child)
select parent, child, round(f, 6) as forward, round(q, 6) as ratio, round((row_number() over (order by coalesce(f, 0), parent, child) - 1) / (count(*) over () - 1), 6) as f_forward from j""")
def _(t):
    up = t("region").join(t("nation"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.lit("x").alias("graph_id"), F.col("r_name").alias("parent"), F.col("n_name").alias("child"))
    return A.perplexity_features(up.union(t("ppl").select(F.lit("x"), "parent", "child")), t("ppl")).select("parent", "child", *r6("forward", "ratio", "f_forward"))


@query("a19_reasoning_effort", ctes("log") + "select dataset, variant, count(*) as n, round(avg(reasoning_chars), 6) as mean_chars, round(avg(produced::int), 6) as productive, cast(sum(edges) as bigint) as edges, cast(ascii(variant) as double) as f1 from log group by all")
def _(t):
    f1 = t("log").select("dataset", "variant", F.ascii("variant").cast("double").alias("f1")).distinct()
    return A.reasoning_effort(t("log"), f1)[0].select("dataset", "variant", "n", *r6("mean_chars", "productive"), "edges", "f1")


@query("a19_reasoning_medians", ctes("log") + """, r as (select variant, produced, reasoning_chars, row_number() over (partition by variant, produced order by reasoning_chars) as r, count(*) over (partition by variant, produced) as n from log)
select variant, max(reasoning_chars) filter (produced) as median_productive, max(reasoning_chars) filter (not produced) as median_empty from r where r = n // 2 + 1 group by variant""")
def _(t):
    f1 = t("log").select("dataset", "variant", F.lit(0.0).alias("f1")).distinct()
    return A.reasoning_effort(t("log"), f1)[1]

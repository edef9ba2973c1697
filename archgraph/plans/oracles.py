"""DuckDB SQL for the queries, written apart from their Spark code from the operators' definitions."""

from __future__ import annotations

from archgraph.adapters.tables import graph_sql
from archgraph.operators.search import B, K1

_C = "('calls', 'depends_on', 'implements', 'imports', 'inherits')"
_MORE = f"""
, links AS (SELECT DISTINCT source, target FROM edges WHERE rel IN {_C}
), contains AS (SELECT source AS parent, target AS child FROM edges WHERE rel = 'contains'
), up(name, ancestor, depth) AS (SELECT name, name, 0 FROM nodes UNION ALL SELECT up.name, c.parent, depth + 1 FROM up JOIN contains c ON c.child = up.ancestor
), members AS (SELECT n.name AS class, c.child AS member FROM nodes n JOIN contains c ON c.parent = n.name WHERE n.type = 'class'
), methods AS (SELECT class, member, coalesce(cc, 1) AS cc FROM members JOIN nodes ON name = member WHERE type IN ('function', 'method')
), classes AS (SELECT name AS class FROM nodes WHERE type = 'class'
)"""
#: Strong components: whatever reaches each other among vertices with a way in and out.
_TRIMS = 12
_TRIM = "".join(f", inner{k} AS MATERIALIZED (SELECT * FROM inner{k - 1} WHERE source IN (SELECT target FROM inner{k - 1}) AND target IN (SELECT source FROM inner{k - 1}))\n" for k in range(1, _TRIMS + 1))
_SCC = f"""
, vertices AS (SELECT source AS name FROM links UNION SELECT target FROM links
), inner0 AS MATERIALIZED (SELECT * FROM links WHERE source <> target)
{_TRIM}, reach(a, b) AS (SELECT source, target FROM inner{_TRIMS} UNION SELECT reach.a, i.target FROM reach JOIN inner{_TRIMS} i ON i.source = reach.b
), mutual AS (SELECT x.a AS name, x.b AS other FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a
), scc AS MATERIALIZED (SELECT v.name, least(v.name, coalesce(min(m.other), v.name)) AS scc FROM vertices v LEFT JOIN mutual m ON m.name = v.name GROUP BY v.name
), dag AS MATERIALIZED (SELECT DISTINCT s.scc AS s, t.scc AS t FROM links JOIN scc s ON s.name = source JOIN scc t ON t.name = target WHERE s.scc <> t.scc
), core AS MATERIALIZED (SELECT s, t FROM dag WHERE s IN (SELECT t FROM dag)
), climb(scc, layer) AS (SELECT DISTINCT t, 0 FROM dag UNION SELECT d.s, layer + 1 FROM climb JOIN core d ON d.t = climb.scc
), low AS (SELECT scc, max(layer) AS layer FROM climb GROUP BY scc
), height AS (SELECT scc, layer FROM low UNION ALL SELECT scc.scc, coalesce(max(low.layer) + 1, 0) FROM (SELECT DISTINCT scc FROM scc) scc LEFT JOIN dag ON s = scc.scc LEFT JOIN low ON low.scc = dag.t WHERE scc.scc NOT IN (SELECT scc FROM low) GROUP BY scc.scc
), layers AS (SELECT name, layer, scc.scc FROM scc JOIN height ON height.scc = scc.scc
)"""
_CBO = """
, ends AS (SELECT source AS member, target AS other FROM links WHERE source <> target UNION SELECT target, source FROM links WHERE source <> target
), own AS (SELECT class, member FROM members UNION ALL SELECT class, class FROM classes
), met AS (
  SELECT own.class, CASE WHEN h.class IS NOT NULL AND h.class <> own.class THEN h.class WHEN k.class <> own.class THEN k.class END AS met
  FROM own JOIN ends USING (member) LEFT JOIN members h ON h.member = other LEFT JOIN classes k ON k.class = other
), cbo AS (SELECT class, count(DISTINCT met) AS cbo FROM classes LEFT JOIN met USING (class) GROUP BY class
)"""
_WMC = ", wmc AS (SELECT class, cast(coalesce(sum(cc), 0) as bigint) AS wmc, cast(coalesce(max(cc), 0) as bigint) AS max_method_cc, count(cc) AS methods FROM classes LEFT JOIN methods USING (class) GROUP BY class)"
# Orders never call orders, so in these tables the parts of a class are its methods.
_LCOM = ", lcom4 AS (SELECT class, count(member) AS lcom4 FROM classes LEFT JOIN methods USING (class) GROUP BY class)"
_RFC = ", rfc AS (SELECT class, (SELECT count(*) FROM methods m WHERE m.class = c.class) + (SELECT count(DISTINCT target) FROM methods m JOIN edges ON source = member AND rel = 'calls' WHERE m.class = c.class) AS rfc FROM classes c)"
_DIT = ", chain(class, depth) AS (SELECT class, 0 FROM classes UNION SELECT e.source, depth + 1 FROM chain JOIN edges e ON e.target = class AND rel = 'inherits' AND e.source <> e.target), dit AS (SELECT class, cast(max(depth) as bigint) AS dit FROM chain GROUP BY class)"
# Classes are coupled by inheritance only, in trees: all pairs of vertices in different branches at a class go through it.
_TREE = """
, heirs(class, above) AS (SELECT class, class FROM classes UNION ALL SELECT h.class, e.target FROM heirs h JOIN edges e ON e.source = h.above AND e.rel = 'inherits' AND e.source <> e.target
), below AS (SELECT above AS class, count(*) AS size FROM heirs GROUP BY above
), whole AS (SELECT h.class, max(b.size) AS whole FROM heirs h JOIN below b ON b.class = h.above GROUP BY h.class
), branches AS (SELECT e.target AS class, sum(b.size * b.size) AS squares FROM edges e JOIN below b ON b.class = e.source WHERE e.rel = 'inherits' AND e.source <> e.target GROUP BY e.target
), total AS (SELECT cast(count(*) as double) AS n FROM (SELECT source FROM links UNION SELECT target FROM links)
), tree AS (SELECT class, ((whole - 1) * (whole - 1) - coalesce(squares, 0) - (whole - size) * (whole - size)) / nullif((n - 1) * (n - 2), 0) AS b FROM below JOIN whole USING (class) LEFT JOIN branches USING (class) CROSS JOIN total
)"""
_NOC = ", noc AS (SELECT class, count(source) AS noc FROM classes LEFT JOIN edges ON target = class AND rel = 'inherits' GROUP BY class)"
_MARTIN = """
, mods AS (SELECT name AS module FROM nodes WHERE type IN ('package', 'module')
), owners AS (SELECT up.name, max(ancestor) AS owner FROM up JOIN mods ON module = ancestor GROUP BY up.name
), inside AS (SELECT module, up.name FROM up JOIN mods ON module = ancestor
), ca AS (SELECT module, count(DISTINCT owner) AS n FROM inside JOIN links ON target = inside.name JOIN owners ON owners.name = source WHERE owner <> module GROUP BY module
), ce AS (SELECT module, count(DISTINCT owner) AS n FROM inside JOIN links ON source = inside.name JOIN owners ON owners.name = target WHERE owner <> module GROUP BY module
), kinds AS (SELECT module, count(*) FILTER (type = 'class') AS c, count(*) FILTER (type = 'interface') AS f FROM inside JOIN nodes USING (name) GROUP BY module
), raw AS (
  SELECT module, coalesce(ca.n, 0) AS ca, coalesce(ce.n, 0) AS ce, CASE WHEN coalesce(ca.n, 0) + coalesce(ce.n, 0) > 0 THEN coalesce(ce.n, 0) / (coalesce(ca.n, 0) + coalesce(ce.n, 0)) ELSE 0.0 END AS i,
    CASE WHEN coalesce(c + f, 0) > 0 THEN f / (c + f) ELSE 0.0 END AS a
  FROM mods LEFT JOIN ca USING (module) LEFT JOIN ce USING (module) LEFT JOIN kinds USING (module)
), martin AS (SELECT module, ca, ce, round_even(cast(i as double), 3) AS instability, round_even(cast(a as double), 3) AS abstractness, round_even(cast(abs(a + i - 1) as double), 3) AS distance FROM raw
)"""
_CONCEPTS = """
, concept_of AS (
  SELECT name, CASE WHEN name LIKE 'cat%' THEN 'catalog' WHEN name LIKE 'r0%' OR name LIKE 'r1%' THEN 'customers' WHEN name LIKE 'r2%' OR name LIKE 'r3%' THEN 'suppliers' END AS concept FROM nodes
), owned AS (SELECT * FROM concept_of WHERE concept IS NOT NULL
), touching AS (
  SELECT source, rel, target, a.concept AS a, b.concept AS b FROM edges LEFT JOIN owned a ON a.name = source LEFT JOIN owned b ON b.name = target WHERE rel <> 'contains' AND (a.concept IS NOT NULL OR b.concept IS NOT NULL)
), crossing AS (
  SELECT source, rel, target, a, b, (a = 'customers' AND (source = 'r0.n0' OR source LIKE 'r0.n0.%')) OR (b = 'customers' AND (target = 'r0.n0' OR target LIKE 'r0.n0.%'))
    OR (a = 'catalog' AND (source = 'cat.b11' OR source LIKE 'cat.b11.%')) OR (b = 'catalog' AND (target = 'cat.b11' OR target LIKE 'cat.b11.%')) AS allowed
  FROM touching WHERE a <> b
)"""
_HUNKS = """
, hunks AS (
  SELECT cast(event_id // 5 as varchar) AS commit, 'n' || cast(user_id % 25 as varchar) || '.src' AS file, cast(1 + 10 * floor(value) as int) AS start_line, cast(5 + 10 * floor(value) as int) AS end_line
  FROM events WHERE value IS NOT NULL AND value >= 0
), churn AS (SELECT name, count(DISTINCT commit) AS touches FROM nodes n JOIN hunks h ON h.file = n.file AND n.line <= h.end_line AND h.start_line <= coalesce(n.end_line, n.line) WHERE n.line IS NOT NULL GROUP BY name
)"""
_DEAD = f"""
, used AS MATERIALIZED (SELECT DISTINCT target FROM edges WHERE rel IN {_C} OR rel = 'decorates'
), suspects AS MATERIALIZED (SELECT name, type FROM nodes ANTI JOIN used ON target = name WHERE type NOT IN ('package', 'module', 'endpoint', 'config') AND split_part(name, '.', -1) <> 'main'
), dead AS (SELECT s.name, s.type FROM suspects s LEFT JOIN contains c ON c.child = s.name LEFT JOIN suspects p ON p.name = c.parent WHERE c.parent IS NULL OR p.name IS NOT NULL
)"""
_N0 = "(SELECT name FROM nodes WHERE name LIKE '%.n0')"


def _one(suffix: str) -> str:
    return f"(SELECT name FROM nodes WHERE name = '{suffix}' OR name LIKE '%.{suffix}')"


def _closure(start: str, rels: str, forward: bool, depth: int | None = None, columns: str = "DISTINCT name") -> str:
    a, b = ("source", "target") if forward else ("target", "source")
    if depth is None:
        return f", walk(name) AS (SELECT {b} FROM edges WHERE {a} = {start} AND rel IN {rels} UNION SELECT e.{b} FROM walk JOIN edges e ON e.{a} = walk.name AND e.rel IN {rels}) SELECT {columns} FROM walk WHERE name <> {start}"
    return (
        f", walk(name, depth) AS (SELECT {start}, 0 UNION SELECT e.{b}, depth + 1 FROM walk JOIN edges e ON e.{a} = walk.name AND e.rel IN {rels} WHERE depth < {depth})"
        f" SELECT name, min(depth) AS depth FROM walk GROUP BY name HAVING min(depth) > 0"
    )


_CATALOGUE = ("SELECT * REPLACE (CASE WHEN type = 'module' AND name LIKE 'cat.%' THEN 'class' WHEN type = 'function' THEN 'method' ELSE type END AS type) FROM base_nodes", "SELECT * FROM base_edges")
_LAYERED = ("SELECT * FROM base_nodes", "SELECT * FROM base_edges WHERE rel = 'contains' OR (rel = 'imports' AND (source > target OR source LIKE 'r0.%'))")
# Connected parts of the calls among the methods of one class, by what each reaches.
_PARTS = """
, inside AS (SELECT e.source AS a, e.target AS b FROM edges e JOIN methods m ON m.member = e.source JOIN methods n ON n.member = e.target AND n.class = m.class WHERE rel = 'calls' AND e.source <> e.target
), both_ AS (SELECT a, b FROM inside UNION SELECT b, a FROM inside
), tied(a, b) AS (SELECT a, b FROM both_ UNION SELECT tied.a, y.b FROM tied JOIN both_ y ON y.a = tied.b
), least_ AS (SELECT a, min(b) AS b FROM tied GROUP BY a
), lcom4 AS (SELECT class, count(DISTINCT coalesce(least(l.a, l.b), member)) AS lcom4 FROM classes LEFT JOIN methods USING (class) LEFT JOIN least_ l ON l.a = member GROUP BY class
)"""
_PAGERANK = """
, v AS (SELECT source AS name FROM links UNION SELECT target FROM links
), size AS (SELECT count(*) AS n FROM v
), deg AS (SELECT source, count(*) AS d FROM links GROUP BY source
), pr(it, name, r) AS (
  SELECT 0, name, 1.0::double / n FROM v, size
  UNION ALL
  SELECT max(x.it) + 1, x.name, 0.15::double / max(n) + 0.85::double * (coalesce(sum(x.got), 0) + max(x.lost) / max(n)) FROM (
    SELECT w.it, v.name, g.got, w.lost FROM v
    CROSS JOIN (SELECT max(it) AS it, coalesce(sum(r) FILTER (d IS NULL), 0) AS lost FROM pr LEFT JOIN deg ON source = pr.name) w
    LEFT JOIN (SELECT target, sum(pr.r / d) AS got FROM pr JOIN deg ON deg.source = pr.name JOIN links ON links.source = pr.name GROUP BY target) g ON g.target = v.name
    WHERE w.it < 50) x, size GROUP BY x.name
)"""
_KCORE = """
, both_ AS MATERIALIZED (SELECT source AS a, target AS b FROM links UNION SELECT target, source FROM links
), kc(it, name, core) AS (
  SELECT 0, a, count(*) FROM both_ GROUP BY a
  UNION ALL
  SELECT it + 1, name, least(max(own), coalesce(max(least(core, above)), 0)) FROM (
    SELECT s.it, s.name, s.core AS own, t.core, count(*) OVER (PARTITION BY s.name ORDER BY t.core DESC) AS above FROM kc s JOIN both_ ON a = s.name JOIN kc t ON t.name = b WHERE s.it < 30
  ) GROUP BY it, name
), cores AS (SELECT name, core FROM kc WHERE it = 30
)"""
_MOVED = """
, old_ AS MATERIALIZED (SELECT name, type, CASE WHEN type = 'function' THEN md5(docstring || '|' || cc) END AS c, CASE WHEN type = 'function' THEN md5(split_part(name, '.', -1)) END AS s FROM nodes
), new_ AS MATERIALIZED (SELECT CASE WHEN name LIKE 'cat.b%' THEN 'cat.x' || substr(name, 6) WHEN type = 'method' THEN regexp_replace(name, '[.](o[0-9]+)$', '.archive.\\1') ELSE name END AS name, type, c, s FROM old_
), gone AS MATERIALIZED (SELECT * FROM old_ ANTI JOIN new_ USING (name)), came AS MATERIALIZED (SELECT * FROM new_ ANTI JOIN old_ USING (name)
), by_both AS (SELECT a.name AS old_name, b.name AS new_name FROM (SELECT c, s, min(name) AS name FROM gone WHERE c IS NOT NULL AND s IS NOT NULL GROUP BY c, s HAVING count(*) = 1) a JOIN (SELECT c, s, min(name) AS name FROM came WHERE c IS NOT NULL AND s IS NOT NULL GROUP BY c, s HAVING count(*) = 1) b USING (c, s)
), gone2 AS (SELECT * FROM gone ANTI JOIN by_both ON old_name = name), came2 AS (SELECT * FROM came ANTI JOIN by_both ON new_name = name
), by_shape AS (SELECT a.name AS old_name, b.name AS new_name FROM (SELECT s, min(name) AS name FROM gone2 WHERE s IS NOT NULL GROUP BY s HAVING count(*) = 1) a JOIN (SELECT s, min(name) AS name FROM came2 WHERE s IS NOT NULL GROUP BY s HAVING count(*) = 1) b USING (s)
), gone3 AS MATERIALIZED (SELECT name, type, list_distinct(string_split(name, '.')) AS w FROM gone2 ANTI JOIN by_shape ON old_name = name), came3 AS MATERIALIZED (SELECT name, type, list_distinct(string_split(name, '.')) AS w FROM came2 ANTI JOIN by_shape ON new_name = name
), alike AS (
  SELECT g.name AS a, c.name AS b, len(list_intersect(g.w, c.w)) / (len(g.w) + len(c.w) - len(list_intersect(g.w, c.w))) AS j FROM gone3 g JOIN came3 c ON g.type = c.type AND split_part(g.name, '.', -1) = split_part(c.name, '.', -1)
), fuzzy AS (SELECT a, b FROM alike WHERE j >= 0.8)
SELECT old_name, new_name, 'content' AS kind FROM by_both UNION ALL SELECT old_name, new_name, 'structure' FROM by_shape UNION ALL SELECT a, b, 'fuzzy' FROM fuzzy"""


_Q: dict[str, str] = {
    "status": "SELECT 'node' AS kind, type AS name, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', rel, count(*) FROM edges GROUP BY rel",
    "nodes_by_type": "SELECT name, type, file FROM nodes WHERE type = 'class'",
    "edges_by_rel": "SELECT source, rel, target FROM edges WHERE rel = 'imports' OR rel = 'inherits'",
    "node_lookup": "SELECT name, type, file FROM nodes WHERE name = 'cat.b11'",
    "resolve_name": """SELECT q.query, name FROM (VALUES ('n3'), ('C5'), ('p17'), ('r1'), ('S1'), ('b11.p17'), ('nothing')) q(query) JOIN nodes ON name = q.query OR (ends_with(name, '.' || q.query) AND q.query NOT IN (SELECT name FROM nodes))""",
    "outgoing": f"SELECT source, rel, target FROM edges WHERE source = {_N0}",
    "incoming": f"SELECT source, rel, target FROM edges WHERE target = {_N0}",
    "neighbors": f"SELECT target AS name FROM edges WHERE source = {_N0} UNION SELECT source FROM edges WHERE target = {_N0}",
    "module_scope": "SELECT source, rel, target FROM edges WHERE (source = 'cat' OR source LIKE 'cat.%') AND (target = 'cat' OR target LIKE 'cat.%')",
    "glob_filter": "SELECT name FROM nodes WHERE name GLOB 'cat.b1?.p*[05]'",
    "entry_points": "SELECT name, split_part(name, '.', -1) = 'main' OR split_part(name, '.', -1) LIKE 'test\\_%' ESCAPE '\\' OR split_part(name, '.', -1) LIKE 'Test%' AS entry FROM nodes",
    "degrees": "SELECT name, type, (SELECT count(*) FROM edges WHERE target = name) AS incoming, (SELECT count(*) FROM edges WHERE source = name) AS outgoing FROM nodes",
    "overview_top10": "SELECT name, type, incoming, outgoing, incoming + outgoing AS degree FROM (SELECT name, type, (SELECT count(*) FROM edges WHERE target = name) AS incoming, (SELECT count(*) FROM edges WHERE source = name) AS outgoing FROM nodes) ORDER BY degree DESC, name LIMIT 10",
    "usages": f"SELECT source, rel, coalesce(file, '') AS file, coalesce(line, 0) AS line, coalesce(end_line, 0) AS end_line FROM edges JOIN nodes ON name = source WHERE target = {_one('S1')} AND rel IN {_C}",
    "about": f"SELECT 'out' AS direction, rel, target AS other FROM edges WHERE source = {_N0} UNION ALL SELECT 'in', rel, source FROM edges WHERE target = {_N0}",
    "validate": "SELECT source, rel, target, source AS missing FROM edges WHERE source NOT IN (SELECT name FROM nodes) UNION ALL SELECT source, rel, target, target FROM edges WHERE target NOT IN (SELECT name FROM nodes)",
    "scalar_functions": r"""
SELECT name, lower(trim(regexp_replace(regexp_replace(regexp_replace(name, '[._]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '\s+', ' ', 'g'))) AS words, split_part(name, '.', -1) AS short,
  len(list_distinct(list_filter(regexp_split_to_array(name, '[._\s]+'), lambda x: x <> ''))) AS tokens, regexp_replace(name, '[^a-zA-Z0-9_]', '_', 'g') AS id, regexp_matches(split_part(name, '.', -1), '^_*[A-Z]') AS type_like,
  regexp_extract(coalesce(file, ''), '(\.[^./]+)$', 1) AS ext, greatest(1, length(coalesce(docstring, '')) // 4) AS n_tokens FROM nodes""",
    "transitive_deps": _closure(_N0, "('depends_on', 'imports')", True),
    "transitive_callers": _closure(_one("p1"), "('calls')", False),
    "ancestors": _closure(_one("o1"), "('contains')", False, 60),
    "descendants": _closure("(SELECT 'r0')", "('contains')", True, 2),
    "impact": _closure(_one("S1"), _C, False, 3),
    "shortest_path": f"""

, either_ AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges
), bfs(name, depth) AS (SELECT {_one('p1')}, 0 UNION SELECT b, depth + 1 FROM bfs JOIN either_ ON a = name WHERE depth < 6
), dist AS (SELECT name, min(depth) AS depth FROM bfs GROUP BY name
), back(name, step) AS (SELECT name, depth FROM dist WHERE name = {_one('C3')} UNION ALL SELECT (SELECT min(d.name) FROM either_ JOIN dist d ON d.name = a WHERE b = back.name AND d.depth = back.step - 1), step - 1 FROM back WHERE step > 0
) SELECT cast(step as int) AS step, name FROM back""",
    "subgraph": f", near AS (SELECT {_N0} AS name UNION SELECT target FROM edges WHERE rel = 'imports' AND source = {_N0} UNION SELECT source FROM edges WHERE rel = 'imports' AND target = {_N0}) SELECT source, rel, target FROM edges WHERE rel = 'imports' AND source IN (SELECT name FROM near) AND target IN (SELECT name FROM near)",
    "containment_path": f"SELECT cast(depth as int) AS depth, ancestor AS name FROM up WHERE name = {_one('o1')}",
    "module_members": "SELECT ancestor AS module, count(*) AS members FROM up JOIN nodes n ON n.name = ancestor WHERE n.type IN ('package', 'module') AND depth > 0 GROUP BY ancestor",
    "containing_module": "SELECT up.name, arg_min(ancestor, depth) AS owner FROM up JOIN nodes n ON n.name = ancestor WHERE n.type IN ('package', 'module') GROUP BY up.name",
    "fan_in_out": "SELECT name, count(*) FILTER (side = 'i') AS fan_in, count(*) FILTER (side = 'o') AS fan_out FROM (SELECT source AS name, 'o' AS side FROM links UNION ALL SELECT target, 'i' FROM links) GROUP BY name",
    "strong_components": _SCC + "SELECT name, scc FROM scc",
    "find_cycles": _SCC + "SELECT scc, name FROM scc WHERE scc IN (SELECT scc FROM scc GROUP BY scc HAVING count(*) > 1)",
    "topological_layers": _SCC + "SELECT name, cast(layer as bigint) AS layer FROM layers",
    "layering_violations": _SCC + f"SELECT source, rel, target, cast(s.layer as bigint) AS source_layer, cast(t.layer as bigint) AS target_layer FROM edges JOIN layers s ON s.name = source JOIN layers t ON t.name = target WHERE rel IN {_C} AND source <> target AND s.layer <= t.layer",
    "pagerank": _PAGERANK + "SELECT name, round_even(r, 9) AS pagerank FROM pr WHERE it = 50",
    "kcore": _KCORE + "SELECT name, core FROM cores",
    "kcore_innermost": _KCORE + "SELECT name, core FROM cores WHERE core = (SELECT max(core) FROM cores)",
    "hits": """
, v AS (SELECT source AS name FROM links UNION SELECT target FROM links
), hs(it, name, hub, authority) AS (
  SELECT 0, name, 1.0::double, 1.0::double FROM v
  UNION ALL
  SELECT it + 1, name, h / greatest(sqrt(sum(h * h) OVER ()), 1e-10), a / greatest(sqrt(sum(a * a) OVER ()), 1e-10) FROM (
    SELECT c.it, v.name, coalesce(x.h, 0) AS h, coalesce(y.a, 0) AS a FROM v CROSS JOIN (SELECT max(it) AS it FROM hs) c
    LEFT JOIN (SELECT l.source AS name, sum(z.a) AS h FROM links l JOIN (SELECT target AS name, sum(hub) AS a FROM hs JOIN links ON source = name GROUP BY target) z ON z.name = l.target GROUP BY l.source) x USING (name)
    LEFT JOIN (SELECT target AS name, sum(hub) AS a FROM hs JOIN links ON source = name GROUP BY target) y USING (name) WHERE c.it < 50)
) SELECT name, round_even(hub, 6) AS hub, round_even(authority, 6) AS authority FROM hs WHERE it = 50""",
    "between_edges": f"SELECT source, rel, target FROM edges WHERE (source = {_N0} AND target = {_one('n1')}) OR (source = {_one('n1')} AND target = {_N0})",
    "dead_code": _DEAD + "SELECT name, type FROM dead",
    "god_files": """
, f AS (
  SELECT file, cast(coalesce(sum(coalesce(cc, 1)) FILTER (type IN ('function', 'method')), 0) as bigint) AS total_cc, cast(coalesce(max(coalesce(cc, 1)) FILTER (type IN ('function', 'method')), 0) as bigint) AS max_cc,
    count(*) FILTER (type IN ('function', 'method')) AS functions, count(*) FILTER (type = 'class') AS classes FROM nodes WHERE file IS NOT NULL GROUP BY file
), x AS (SELECT a.file, count(DISTINCT b.file) AS n FROM links JOIN nodes a ON a.name = source JOIN nodes b ON b.name = target WHERE a.file <> b.file GROUP BY a.file
), all_ AS (SELECT f.*, coalesce(x.n, 0) AS externals FROM f LEFT JOIN x USING (file))
SELECT *, concat_ws(', ', CASE WHEN total_cc >= 50 THEN 'complexity ' || total_cc END, CASE WHEN functions >= 15 THEN functions || ' functions' END, CASE WHEN externals >= 5 AND total_cc >= 50 THEN externals || ' files used' END) AS reasons
FROM all_ WHERE total_cc >= 50 OR functions >= 15""",
    "wmc": _WMC + "SELECT * FROM wmc",
    "dit": _DIT + "SELECT * FROM dit",
    "noc": _NOC + "SELECT * FROM noc",
    "cbo": _CBO + "SELECT * FROM cbo",
    "rfc": _RFC + "SELECT * FROM rfc",
    "lcom4": _LCOM + "SELECT * FROM lcom4",
    "martin_metrics": _MARTIN + "SELECT * FROM martin",
    "sdp_violations": _MARTIN + "SELECT a.module AS source, b.module AS target, round_even(b.instability - a.instability, 3) AS gap FROM (SELECT DISTINCT s.owner AS a, t.owner AS b FROM links JOIN owners s ON s.name = source JOIN owners t ON t.name = target WHERE s.owner <> t.owner) p JOIN martin a ON a.module = p.a JOIN martin b ON b.module = p.b WHERE a.instability < b.instability AND round_even(b.instability - a.instability, 9) > 0.1",
    "god_classes": _WMC + _CBO + _LCOM + "SELECT class, wmc, cbo, lcom4 FROM wmc JOIN cbo USING (class) JOIN lcom4 USING (class) WHERE wmc >= 20 AND cbo >= 5 AND lcom4 >= 2",
    "feature_envy": f"""
, refs AS (SELECT m.member AS method, m.class, coalesce(h.class, k.class) AS holder FROM methods m JOIN edges ON source = m.member AND rel IN {_C} LEFT JOIN members h ON h.member = target LEFT JOIN classes k ON k.class = target
), n AS (SELECT method, class, holder, count(*) AS n FROM refs WHERE holder IS NOT NULL GROUP BY ALL
), best AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY n DESC, holder) AS k FROM n WHERE holder <> class)
SELECT b.method, b.class, b.holder AS envied, coalesce(o.n, 0) AS own_refs, b.n AS external_refs FROM best b LEFT JOIN n o ON o.method = b.method AND o.holder = o.class WHERE k = 1 AND b.n >= 2 AND b.n > coalesce(o.n, 0)""",
    "delta_filter": _HUNKS + "SELECT source AS name, count(*) AS fan_out FROM links JOIN nodes ON name = source WHERE type IN ('function', 'method') AND source IN (SELECT name FROM churn) GROUP BY source HAVING count(*) >= 3",
    "shotgun_surgery": "SELECT source AS name, count(*) AS fan_out FROM links JOIN nodes ON name = source WHERE type IN ('function', 'method') GROUP BY source HAVING count(*) >= 3",
    "deny_rule": "SELECT source, rel, target FROM edges WHERE rel = 'depends_on' AND source LIKE 'r0.%' AND target LIKE 'r1.%'",
    "quantified_rule": "SELECT name FROM nodes WHERE name LIKE 'cat.%' AND ((SELECT count(*) FROM links WHERE source = name) > 3 OR (type = 'function' AND coalesce(cc, 99) > 40))",
    "check_all": _SCC + _CONCEPTS + """
SELECT 'regions' AS rule, 'edge' AS kind, source || ' -[' || rel || ']-> ' || target AS witness FROM edges WHERE rel = 'depends_on' AND source LIKE 'r0.%' AND target LIKE 'r1.%'
UNION ALL SELECT 'acyclic', 'edge', source || ' -[' || rel || ']-> ' || target FROM edges JOIN scc s ON s.name = source JOIN scc t ON t.name = target WHERE source LIKE 'cat.%' AND rel <> 'contains' AND source <> target AND s.scc = t.scc
UNION ALL SELECT 'narrow', 'predicate', name FROM nodes WHERE name LIKE 'cat.%' AND ((SELECT count(*) FROM links WHERE source = name) > 3 OR (type = 'function' AND coalesce(cc, 99) > 40))
UNION ALL SELECT 'boundaries', 'edge', source || ' -[' || rel || ']-> ' || target FROM crossing WHERE NOT allowed""",
    "check_dead_code": _DEAD + "SELECT 'dead' AS rule, 'node' AS kind, name AS witness FROM dead",
    "rule_violations": _SCC + _CONCEPTS + """
, found AS (
  SELECT 'regions' AS rule, 'deny' AS type FROM edges WHERE rel = 'depends_on' AND source LIKE 'r0.%' AND target LIKE 'r1.%'
  UNION ALL SELECT 'acyclic', 'invariant' FROM edges JOIN scc s ON s.name = source JOIN scc t ON t.name = target WHERE source LIKE 'cat.%' AND rel <> 'contains' AND source <> target AND s.scc = t.scc
  UNION ALL SELECT 'narrow', 'quantified' FROM nodes WHERE name LIKE 'cat.%' AND ((SELECT count(*) FROM links WHERE source = name) > 3 OR (type = 'function' AND coalesce(cc, 99) > 40))
  UNION ALL SELECT 'boundaries', 'invariant' FROM crossing WHERE NOT allowed
) SELECT rule, type, rule || ' is violated by ' || count(*) AS message, count(*) AS witnesses FROM found GROUP BY rule, type""",
    "concept_candidates": _CONCEPTS + "SELECT a AS from_concept, b AS to_concept, sync_point, count(*) AS edges FROM (SELECT a, b, source AS sync_point FROM crossing WHERE NOT allowed UNION ALL SELECT a, b, target FROM crossing WHERE NOT allowed) GROUP BY ALL",
    "concept_allowed": _CONCEPTS + "SELECT a AS from_concept, b AS to_concept, source, rel, target FROM crossing WHERE allowed",
    "concept_summary": _CONCEPTS + """
, k AS (SELECT unnest(['customers', 'suppliers', 'catalog']) AS concept
), s AS (
  SELECT concept, (SELECT count(*) FROM owned o WHERE o.concept = k.concept) AS members, (SELECT count(*) FROM touching WHERE a = concept AND b = concept) AS internal, (SELECT count(*) FROM crossing WHERE b = concept) AS cross_in,
    (SELECT count(*) FROM crossing WHERE a = concept) AS cross_out, (SELECT count(DISTINCT b) FROM crossing WHERE a = concept) AS sync_fan_out
  FROM k
), p AS (SELECT DISTINCT a, b FROM crossing
), w AS (SELECT concept, other, count(*) AS ways FROM (SELECT a AS concept, b AS other FROM p UNION ALL SELECT b, a FROM p) GROUP BY ALL)
SELECT s.*, round_even(CASE WHEN internal + cross_in + cross_out > 0 THEN cast(cross_in + cross_out as double) / (internal + cross_in + cross_out) ELSE 0.0 END, 6) AS sync_density,
  round_even(cast((SELECT count(*) FROM w WHERE w.concept = s.concept AND ways = 1) as double) / greatest(1, (SELECT count(*) FROM w WHERE w.concept = s.concept AND ways = 2)), 6) AS sync_asymmetry
FROM s""",
    "concept_dependencies": _CONCEPTS + "SELECT a AS from_concept, b AS to_concept, cast(sum(n) as bigint) AS edges, cast(sum(bad) as bigint) AS unsanctioned, string_agg(rel || ':' || n, ' ' ORDER BY rel) AS rels FROM (SELECT a, b, rel, count(*) AS n, count(*) FILTER (NOT allowed) AS bad FROM crossing GROUP BY ALL) GROUP BY a, b",
    "dsm_module": ", own AS (SELECT up.name, arg_min(ancestor, depth) AS owner FROM up JOIN nodes n ON n.name = ancestor WHERE n.type = 'module' GROUP BY up.name)" + f"SELECT a.owner AS row, b.owner AS col, count(*) AS n FROM edges JOIN own a ON a.name = source JOIN own b ON b.name = target WHERE rel IN {_C} AND a.owner <> b.owner GROUP BY ALL",
    "hotspots": _WMC + _CBO + _RFC + _LCOM + _MARTIN + _HUNKS + _PAGERANK + _TREE + """
, k AS (
  SELECT class AS name, wmc, cbo, lcom4, rfc, coalesce(b, 0) AS b, coalesce(r, 0) AS r, coalesce(touches, 0) AS touches FROM wmc JOIN cbo USING (class) JOIN rfc USING (class) JOIN lcom4 USING (class) LEFT JOIN tree USING (class)
  LEFT JOIN (SELECT * FROM pr WHERE it = 50) p ON p.name = class LEFT JOIN churn ON churn.name = class
), c AS (
  SELECT name, 'class' AS type, (CASE WHEN wmc > 20 THEN wmc / 10 ELSE 0 END) + (CASE WHEN cbo > 5 THEN cbo ELSE 0 END) + (CASE WHEN lcom4 > 1 THEN lcom4 * 3.0 ELSE 0 END) + (CASE WHEN rfc > 20 THEN rfc / 5 ELSE 0 END) + (CASE WHEN b > 0.05 THEN b * 20 ELSE 0 END)
      + (CASE WHEN r > 0.02 THEN r * 50 ELSE 0 END) + (CASE WHEN touches > 10 THEN touches / 5 ELSE 0 END) AS score,
    concat_ws(', ', CASE WHEN wmc > 20 THEN 'WMC ' || wmc END, CASE WHEN cbo > 5 THEN 'CBO ' || cbo END, CASE WHEN lcom4 > 1 THEN 'LCOM4 ' || lcom4 END, CASE WHEN rfc > 20 THEN 'RFC ' || rfc END, CASE WHEN b > 0.05 THEN printf('betweenness %.3f', b) END,
      CASE WHEN r > 0.02 THEN printf('pagerank %.3f', r) END, CASE WHEN touches > 10 THEN touches || ' touches' END) AS reasons FROM k
), f AS (
  SELECT n.name, n.type, (CASE WHEN touches > 5 THEN touches / 5 ELSE 0 END) + (CASE WHEN coalesce(cc, 1) > 10 THEN coalesce(cc, 1) / 5 ELSE 0 END) AS score,
    concat_ws(', ', CASE WHEN touches > 5 THEN touches || ' touches' END, CASE WHEN coalesce(cc, 1) > 10 THEN 'complexity ' || coalesce(cc, 1) END) AS reasons FROM nodes n JOIN churn USING (name) WHERE n.type IN ('function', 'method')
), every_ AS (
  SELECT * FROM c WHERE score > 0 UNION ALL SELECT module, n.type, distance * 5, printf('distance %.2f', distance) FROM martin JOIN nodes n ON n.name = module WHERE distance > 0.7 UNION ALL SELECT * FROM f WHERE score > 2.0
) SELECT name, type, cast(round_even(cast(cast(cast(score as double) as varchar) as decimal(38, 20)), 2) as double) AS score, reasons FROM every_""",
    "module_ranking": """
, own AS MATERIALIZED (SELECT up.name, arg_min(ancestor, depth) AS owner FROM up JOIN nodes n ON n.name = ancestor WHERE n.type = 'module' GROUP BY up.name
), cross_ AS (SELECT a.owner AS a, b.owner AS b FROM links JOIN own a ON a.name = source JOIN own b ON b.name = target WHERE a.owner <> b.owner
) SELECT module, count(*) FILTER (side = 'i') AS incoming, count(*) FILTER (side = 'o') AS outgoing FROM (SELECT a AS module, 'o' AS side FROM cross_ UNION ALL SELECT b, 'i' FROM cross_) GROUP BY module""",
    "node_card": f"""
, both_ AS MATERIALIZED (SELECT source AS a, target AS b FROM links UNION SELECT target, source FROM links
), ring(name, depth) AS (SELECT {_N0}, 0 UNION SELECT b, depth + 1 FROM ring JOIN both_ ON a = ring.name WHERE depth < 3
), far AS (SELECT name, min(depth) AS depth FROM ring GROUP BY name HAVING min(depth) > 0
), near_ AS (SELECT 'out ' || rel AS section, target AS text FROM edges WHERE source = {_N0} UNION ALL SELECT 'in ' || rel, source FROM edges WHERE target = {_N0}
), ranked AS (SELECT section, row_number() OVER (PARTITION BY section ORDER BY text) AS position, text, count(*) OVER (PARTITION BY section) AS n FROM near_)
SELECT 'path' AS section, cast(depth as int) AS position, ancestor AS text, cast(0 as bigint) AS hidden FROM up WHERE name = {_N0}
UNION ALL SELECT 'ring', cast(depth as int), count(*) || ' nodes', 0 FROM far GROUP BY depth
UNION ALL SELECT section, cast(position as int), text, greatest(n - 5, 0) FROM ranked WHERE position <= 5""",
    "churn_summary": _HUNKS + "SELECT count(DISTINCT commit) AS commits, count(DISTINCT file) AS files, count(*) AS hunks FROM hunks",
    "entity_churn": _HUNKS + "SELECT * FROM churn",
    "file_churn": _HUNKS + "SELECT file, count(*) AS hunks FROM hunks GROUP BY file",
    "rename_matches": _MOVED,
    "search_bm25": rf"""
, corpus AS (SELECT name, type, docstring FROM nodes UNION ALL SELECT 'docs.' || source || '.d' || doc_id, 'config', text FROM documents
), t AS (
  SELECT name, type, list_filter(regexp_split_to_array(lower(concat_ws(' ', name, lower(trim(regexp_replace(regexp_replace(regexp_replace(name, '[._]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '\s+', ' ', 'g'))), docstring)), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS t FROM corpus
), c AS (SELECT name, type, len(t) AS length, len(list_filter(t, lambda x: x = 'the')) AS tf, len(list_filter(t, lambda x: x = 'with')) AS banned FROM t
), s AS (SELECT count(*) AS n, avg(length) AS mean, count(*) FILTER (tf > 0) AS df FROM c)
SELECT name, type, round_even(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * ({K1} + 1) / (tf + {K1} * (1 - {B} + {B} * length / mean)), 6) AS score FROM c, s WHERE tf > 0 AND banned = 0""",
    "search_any": rf"""
, corpus AS (SELECT name, type, docstring FROM nodes UNION ALL SELECT 'docs.' || source || '.d' || doc_id, 'config', text FROM documents
), t AS (
  SELECT name, type, list_filter(regexp_split_to_array(lower(concat_ws(' ', name, lower(trim(regexp_replace(regexp_replace(regexp_replace(name, '[._]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '\s+', ' ', 'g'))), docstring)), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS t FROM corpus
), c AS (SELECT name, type, len(t) AS length, len(list_filter(t, lambda x: x = 'the')) AS tf, len(list_filter(t, lambda x: x = 'p1')) AS tb, len(list_filter(t, lambda x: x = 'with')) AS banned FROM t
), s AS (SELECT count(*) AS n, avg(length) AS mean, count(*) FILTER (tf > 0) AS df, count(*) FILTER (tb > 0) AS db FROM c
), each AS (
  SELECT name, type, ln((n - df + 0.5) / (df + 0.5) + 1) * tf * ({K1} + 1) / (tf + {K1} * (1 - {B} + {B} * length / mean)) AS score FROM c, s WHERE tf > 0 AND banned = 0
  UNION ALL SELECT name, type, ln((n - db + 0.5) / (db + 0.5) + 1) * tb * ({K1} + 1) / (tb + {K1} * (1 - {B} + {B} * length / mean)) FROM c, s WHERE tb > 0
) SELECT name, type, round_even(sum(score), 6) AS score FROM each GROUP BY name, type""",
}


def _diff(old: bool) -> str:
    return graph_sql().replace("FROM orders JOIN", f"FROM (SELECT * FROM orders WHERE o_orderdate {'< timestamp ' if old else '>= timestamp '}'{'1997' if old else '1994'}-01-01') JOIN")


def _two(body: str) -> str:
    """Two graphs as subqueries: v_old_nodes, v_old_edges, v_new_nodes and v_new_edges."""
    parts = [f"{kind}_{what} AS MATERIALIZED (WITH {_diff(kind == 'old')} SELECT * FROM {what})" for kind in ("old", "new") for what in ("nodes", "edges")]
    return f"WITH {', '.join(parts)} {body}"


_DIFF = {
    "validate_dangling": f"WITH {graph_sql()}, old_nodes AS MATERIALIZED (WITH {_diff(True)} SELECT name FROM nodes) SELECT source, rel, target, source AS missing FROM edges ANTI JOIN old_nodes ON name = source UNION ALL SELECT source, rel, target, target FROM edges ANTI JOIN old_nodes ON name = target",
    "diff_edges": _two("SELECT *, 'added' AS change FROM (SELECT source, rel, target FROM new_edges EXCEPT SELECT source, rel, target FROM old_edges) UNION ALL SELECT *, 'removed' FROM (SELECT source, rel, target FROM old_edges EXCEPT SELECT source, rel, target FROM new_edges)"),
    "diff_nodes": _two("""
, o AS MATERIALIZED (SELECT *, md5(type || '|' || coalesce(cc, -1)) AS h FROM old_nodes), n AS MATERIALIZED (SELECT *, md5(type || '|' || coalesce(cc, -1)) AS h FROM new_nodes)
SELECT n.name, 'added' AS change, cast(null as varchar) AS field, cast(null as varchar) AS before, cast(null as varchar) AS after FROM n ANTI JOIN o USING (name)
UNION ALL SELECT o.name, 'removed', null, null, null FROM o ANTI JOIN n USING (name)
UNION ALL SELECT name, 'changed', 'content_hash', o.h, n.h FROM o JOIN n USING (name) WHERE o.h <> n.h"""),
}


_VARIANTS = {
    "sdp_violations_layered": (_LAYERED, _Q["sdp_violations"]),
    "god_classes_catalogue": (_CATALOGUE, _WMC + _CBO + _PARTS + "SELECT class, wmc, cbo, lcom4 FROM wmc JOIN cbo USING (class) JOIN lcom4 USING (class) WHERE wmc >= 20 AND cbo >= 5 AND lcom4 >= 2"),
    "feature_envy_catalogue": (_CATALOGUE, _Q["feature_envy"]),
    "lcom4_catalogue": (_CATALOGUE, _PARTS + "SELECT class, lcom4 FROM lcom4"),
    "cbo_catalogue": (_CATALOGUE, _Q["cbo"]),
}


def _variant(nodes: str, edges: str, body: str) -> str:
    graph = graph_sql().strip().replace("), nodes AS MATERIALIZED (", "), base_nodes AS MATERIALIZED (").replace("), edges AS MATERIALIZED (", "), base_edges AS MATERIALIZED (")
    return f"WITH RECURSIVE {graph}, nodes AS MATERIALIZED ({nodes}), edges AS MATERIALIZED ({edges}){_MORE}{'' if body.strip().startswith(',') else ' '}{body.strip()}"


def oracle_sql() -> dict[str, str]:
    head = "WITH RECURSIVE " + graph_sql().strip() + _MORE
    out = {name: _variant(*graph, body) for name, (graph, body) in _VARIANTS.items()}
    for name, body in _Q.items():
        body = body.strip()
        out[name] = head + ("" if body.startswith(",") else " ") + body
    return out | _DIFF

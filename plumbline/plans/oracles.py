"""DuckDB SQL for the queries of the catalogue, on the same rules of evidence."""

from __future__ import annotations

DOCS = """
WITH d AS (
  SELECT doc_id, 'c' || (doc_id // 4) AS change_id, 'f' || doc_id AS path, (doc_id % 4)::INT AS file_ord, string_split(text, chr(10)) AS a
  FROM documents WHERE text IS NOT NULL),
l0 AS (SELECT doc_id, change_id, path, file_ord, generate_subscripts(a, 1)::INT AS line, unnest(a) AS txt FROM d),
l AS (SELECT *, (trim(txt, ' ') = '' OR (doc_id + line * 5) % 11 = 0) AS inert FROM l0),
ow AS (SELECT *, line - (line - 1) % 3 AS owner FROM l WHERE NOT inert),
isl AS (
  SELECT *, CASE WHEN lag(owner) OVER w = owner AND lag(line) OVER w = line - 1 THEN 0 ELSE 1 END AS st
  FROM ow WINDOW w AS (PARTITION BY path ORDER BY line)),
isl2 AS (SELECT *, sum(st) OVER (PARTITION BY path ORDER BY line) AS run FROM isl),
runs AS (SELECT change_id, path, min(line) AS rfirst, max(line) AS rlast, min(owner) AS owner FROM isl2 GROUP BY change_id, path, run),
ch AS (SELECT * FROM l WHERE (doc_id * 31 + line) % 7 = 0 AND doc_id % 13 <> 0),
att AS (
  SELECT ch.doc_id, ch.change_id, ch.path, ch.file_ord, ch.line, CASE WHEN ch.doc_id % 53 = 0 THEN -1 ELSE r.owner END AS owner
  FROM ch LEFT JOIN runs r ON ch.path = r.path AND ch.line BETWEEN r.rfirst AND r.rlast),
st AS (
  SELECT doc_id, change_id, path, file_ord, owner, CASE WHEN owner = -1 THEN line ELSE owner END AS stmt, min(line) AS first_line
  FROM att WHERE owner IS NOT NULL GROUP BY ALL),
st2 AS (SELECT doc_id, change_id, path, file_ord, owner, stmt, min(first_line) AS first_line FROM st GROUP BY ALL),
ss0 AS (
  SELECT *, owner <> -1 AND (doc_id * 17 + stmt * 7) % 11 <> 0 AS cov,
         (doc_id * 17 + stmt * 7) % 11 = 0 AND (doc_id * 5 + stmt * 3) % 4 = 0 AS exc0,
         (doc_id * 7 + stmt) % 37 = 0 OR (doc_id * 7 + first_line) % 37 = 0 AS gap
  FROM st2),
ss AS (SELECT *, exc0 AND NOT cov AS exc FROM ss0),
bf AS (
  SELECT d.change_id, d.path, d.file_ord, (SELECT count(*) > 0 FROM ch WHERE ch.path = d.path) AS had_lines,
         count(ss.stmt) AS statements, count(*) FILTER (ss.cov) AS covered, count(*) FILTER (ss.exc) AS excluded,
         count(*) FILTER (ss.gap) AS gaps, count(*) FILTER (NOT ss.cov) AS uncovered
  FROM d LEFT JOIN ss ON d.path = ss.path GROUP BY d.change_id, d.path, d.file_ord),
ru AS (
  SELECT change_id, bool_and(statements - excluded > 0 AND covered >= statements - excluded AND gaps = 0) AS clc, sum(statements)::BIGINT AS total,
         sum(covered)::BIGINT AS covered, sum(gaps)::BIGINT AS gaps, sum(uncovered)::BIGINT AS unc, count(*) FILTER (uncovered > 0) AS fwu,
         count(*) FILTER (had_lines AND statements = 0) AS inert_files, count(*) FILTER (NOT had_lines) AS removal_files, count(*) AS files
  FROM bf GROUP BY change_id),
un AS (SELECT DISTINCT change_id, path, doc_id FROM ch WHERE doc_id % 47 = 0),
fs AS (SELECT *, least(n, 2) AS fs FROM (SELECT change_id, file_ord, path, count(*) AS n FROM ss WHERE NOT cov GROUP BY ALL)),
fp AS (
  SELECT *, sum(fs) OVER (PARTITION BY change_id) AS t, sum(n) OVER (PARTITION BY change_id) AS total,
         coalesce(sum(fs) OVER w, 0) AS p, coalesce(sum(n - fs) OVER w, 0) AS x
  FROM fs WINDOW w AS (PARTITION BY change_id ORDER BY file_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fk AS (SELECT *, CASE WHEN t > 6 THEN greatest(0, least(fs, 6 - p)) ELSE fs + greatest(0, least(n - fs, 6 - t - x)) END AS taken FROM fp),
sh AS (
  SELECT u.*, fk.total::BIGINT AS tot FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY first_line) AS rn FROM ss WHERE NOT cov) u
  JOIN fk ON u.path = fk.path WHERE u.rn <= fk.taken)
"""

PAGES = """
WITH p AS (
  SELECT page_id, 'c' || (page_id // 3) AS change_id, html, regexp_replace(url, '^https?://([^/]*)/.*$', '\\1') AS host,
         CASE WHEN page_id % 5 = 0 THEN 'tests/' WHEN page_id % 7 = 0 THEN './src/' WHEN page_id % 11 = 0 THEN '..\\up/' ELSE 'src\\' END AS folder,
         ['.py', '.py', '.ts', '.py', '_test.py', '.md', '.mjs', '.spec.ts'][(page_id % 8 + 1)::INT] AS ext
  FROM pages),
f AS (SELECT *, folder || host || '_' || page_id || ext AS path FROM p),
nf AS (SELECT *, regexp_replace(replace(regexp_replace(path, '^[ab]/', ''), '\\', '/'), '^\\./', '') AS norm, replace(path, '\\', '/') AS slashed FROM f)
"""

REFS = """
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/?([^"]+)"', 1)) AS module FROM pages),
t AS (SELECT page_id, string_split(module, '.')[1] AS top, 'shadow' AS side FROM h UNION ALL SELECT page_id + 1, string_split(module, '.')[1], 'base' FROM h),
known AS (SELECT DISTINCT top FROM t WHERE length(top) % 3 = 0),
bad AS (SELECT * FROM t WHERE top NOT IN (SELECT top FROM known)),
i AS (
  SELECT DISTINCT page_id, top FROM bad b WHERE side = 'shadow' AND page_id IN (SELECT page_id FROM pages)
  AND NOT EXISTS (SELECT 1 FROM bad x WHERE x.side = 'base' AND x.page_id = b.page_id AND x.top = b.top))
"""

LOGS = """
WITH e AS (
  SELECT event_id, user_id AS suite, event_type, json_extract_string(props, '$.k') AS k FROM events),
f AS (
  SELECT event_id, suite, CASE WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN 'src/s' || suite || '.spec.mjs' WHEN event_type = 'purchase' THEN 'src/s' || suite || '.test.ts > adds ' || k || ' > t'
         ELSE 'tests/s' || suite || '.py::t' || k END AS test_id FROM e WHERE event_type IN ('error', 'signup', 'purchase'))
"""

RUNS = """
WITH e AS (SELECT event_id, user_id, event_type, (event_type IN ('error', 'purchase'))::INT AS code FROM events)
"""

MUTANTS = """
WITH m AS (
  SELECT *, CASE WHEN l_returnflag = 'N' THEN 'constant' ELSE 'operator' END AS kind,
         CASE WHEN l_partkey % 5 = 0 THEN 'inconclusive' WHEN l_linestatus = 'O' THEN 'killed' ELSE 'survived' END AS outcome
  FROM lineitem),
r AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (kind = 'constant')::INT, l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS rn FROM m)
"""

FUSED = """
WITH g AS (
  SELECT o_orderkey AS k, k % 19 <> 0 AS s, k % 17 <> 0 AS i, k % 5 <> 0 AS t,
         CASE WHEN k % 25 = 0 THEN 'NO_RUNNER' WHEN k % 10 = 0 THEN 'BASELINE_RED' WHEN k % 5 = 0 THEN 'FAILED' ELSE 'PASSED' END AS tc,
         CASE WHEN o_orderstatus = 'P' THEN 'unknown' WHEN k % 3 = 0 THEN 'false' ELSE 'true' END AS cov,
         (k % 23 = 1)::INT + (k % 29 = 1)::INT AS gaps, (k % 7 = 1)::INT + (k % 14 = 1)::INT AS sv, (k % 11 = 2)::INT + (k % 22 = 2)::INT AS va, (k % 13 = 3)::INT AS fl,
         CASE WHEN o_orderpriority LIKE '1%' THEN 'narrowed' WHEN o_orderpriority LIKE '5%' THEN 'unknown' ELSE 'full' END AS sc,
         k % 9 AS tot, greatest(k % 9 - 3, 0) AS cs, k % 2 AS rem, (k // 2) % 2 AS ine, k % 4 = 0 AS acc
  FROM orders),
u AS (SELECT *, s AND i AND NOT t AND tc IN ('NO_RUNNER', 'BASELINE_RED') AS unj, NOT s OR NOT i OR NOT t AS failed,
             acc AND cov = 'false' AND k % 4 = 0 AS nothing FROM g),
c AS (
  SELECT *, CASE WHEN cov = 'true' AND sv = 1 THEN 'SURVIVOR_ONE' WHEN cov = 'true' AND sv > 1 THEN 'SURVIVOR_MANY'
                 WHEN nothing AND ine = 0 THEN 'REMOVAL_ONLY' WHEN nothing AND rem = 0 THEN 'INERT_ONLY' WHEN nothing THEN 'REMOVAL_AND_INERT'
                 WHEN cov = 'unknown' THEN 'COVERAGE_UNKNOWN' WHEN gaps = 1 THEN 'BRANCH_ONE' WHEN gaps > 1 THEN 'BRANCH_MANY'
                 WHEN tot > 0 AND cs > 0 THEN 'PARTIAL' ELSE 'NOT_EXERCISED' END AS why,
         cov = 'true' AND gaps = 0 AND sv = 0 AND va = 0 AND fl = 0 AND sc <> 'narrowed' AS clean
  FROM u),
v AS (
  SELECT k AS o_orderkey,
         CASE WHEN unj THEN 'UNPROVEN' WHEN failed THEN 'UNSAFE' WHEN clean THEN 'SAFE' ELSE 'UNPROVEN' END AS verdict,
         CASE WHEN unj THEN tc WHEN NOT s THEN 'GATE_SYNTAX' WHEN NOT i THEN 'GATE_IMPORTS' WHEN NOT t THEN 'GATE_TESTS' WHEN clean THEN 'SAFE'
              WHEN cov = 'true' AND sc = 'narrowed' THEN 'NARROWED' WHEN cov = 'true' AND fl > 0 THEN 'FLAKY'
              WHEN cov = 'true' AND va = 1 THEN 'VARIED_ONE' WHEN cov = 'true' AND va > 1 THEN 'VARIED_MANY' ELSE why END AS reason_code,
         CASE WHEN unj THEN 'unknown' ELSE sc END AS scope
  FROM c)
"""

#: As FUSED, with survivors and outcomes that varied counted for every change.
CHECKED = FUSED.replace("(k % 7 = 1)::INT + (k % 14 = 1)::INT AS sv, (k % 11 = 2)::INT + (k % 22 = 2)::INT AS va", "coalesce(ms.n, 0) AS sv, coalesce(vs.n, 0) AS va").replace(
    "  FROM orders),", """  FROM orders LEFT JOIN (
    SELECT l_orderkey, count(*) FILTER (outcome = 'survived') AS n FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'N')::INT, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn,
             CASE WHEN l_partkey % 5 = 0 THEN 'inconclusive' WHEN l_linestatus = 'O' THEN 'killed' ELSE 'survived' END AS outcome FROM lineitem)
    WHERE rn <= 3 GROUP BY l_orderkey) ms ON o_orderkey = ms.l_orderkey
  LEFT JOIN (
    SELECT event_id // 5 AS suite, count(DISTINCT CASE WHEN event_type = 'error' THEN 't' || user_id ELSE 'run ' || (event_id % 5) END) AS n
    FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1) vs ON o_orderkey = vs.suite),""", 1)

LINKS = """
WITH RECURSIVE p AS (
  SELECT page_id, regexp_replace(url, '^https?://([^/]*)/.*$', '\\1') AS tree FROM pages),
t AS (SELECT DISTINCT tree, '/r/' || tree AS root FROM p),
lk AS (
  SELECT tree, root || '/' || x.a AS path, CASE WHEN x.a = 'l5' THEN root || '/d1' ELSE x.b END AS target
  FROM t, (SELECT unnest(['l0', 'l1', 'l2', 'l3', 'l4', 'l5', 'l6', 'l7']) AS a, unnest(['d0', 'l0', '../../etc', 'l4', 'l3', '', 'gone', 'l1/../d2']) AS b) x),
ex AS (
  SELECT DISTINCT tree, unnest(['/r/' || tree || '/d' || (page_id % 7), '/r/' || tree || '/d' || (page_id % 7) || '/p' || page_id, '/r/' || tree, '/r', '/etc', '/etc/passwd', '/']) AS path FROM p),
fx AS (SELECT DISTINCT tree, unnest(['/r/' || tree || '/d' || (page_id % 7), '/r/' || tree, '/r', '/etc']) AS path FROM p),
c AS (
  SELECT DISTINCT tree, CASE WHEN page_id % 10 < 8 THEN 'l' || (page_id % 10) || CASE WHEN page_id % 3 = 0 THEN '/passwd' ELSE '/p' || page_id END
         WHEN page_id % 10 = 8 THEN 'd' || (page_id % 7) || '/./p' || page_id ELSE '../' || tree || '/x/../d' || (page_id % 7) || '/new/p' || page_id END AS rel,
         CASE WHEN page_id % 10 < 8 THEN ['r', tree, 'l' || (page_id % 10), CASE WHEN page_id % 3 = 0 THEN 'passwd' ELSE 'p' || page_id END]
         WHEN page_id % 10 = 8 THEN ['r', tree, 'd' || (page_id % 7), 'p' || page_id] ELSE ['r', tree, 'd' || (page_id % 7), 'new', 'p' || page_id] END AS parts FROM p),
w AS (SELECT tree, rel, parts, unnest(range(0, len(parts) + 1)) AS d FROM c),
walk(tree, rel, d, res, rem, hops) AS (
  SELECT tree, rel, d, []::VARCHAR[], parts[1:d], 0 FROM w
  UNION ALL
  SELECT k.tree, rel, d,
         CASE WHEN rem[1] = '..' THEN res[1:-2] WHEN l.target IS NULL THEN list_append(res, rem[1]) WHEN l.target LIKE '/%' THEN [] ELSE res END,
         CASE WHEN l.target IS NULL OR rem[1] = '..' THEN rem[2:] ELSE list_concat(list_filter(string_split(l.target, '/'), lambda x: x <> ''), rem[2:]) END,
         hops + (l.target IS NOT NULL AND rem[1] <> '..')::INT
  FROM walk k LEFT JOIN lk l ON l.tree = k.tree AND l.path = '/' || array_to_string(list_append(res, rem[1]), '/')
  LEFT JOIN fx f ON f.tree = k.tree AND f.path = '/' || array_to_string(res, '/')
  WHERE len(rem) > 0 AND hops <= 40 AND (rem[1] <> '..' OR len(res) = 0 OR f.path IS NOT NULL)),
r AS (SELECT tree, rel, d, '/' || array_to_string(res, '/') AS real FROM walk WHERE len(rem) = 0 AND hops <= 40),
g AS (SELECT r.* FROM r JOIN ex ON r.tree = ex.tree AND r.real = ex.path),
b AS (SELECT tree, rel, arg_max(real, d) AS real, max(d) AS d FROM g GROUP BY tree, rel)
SELECT c.tree, c.rel, CASE WHEN b.d = len(c.parts) THEN b.real END AS real, coalesce(b.real = '/r/' || c.tree OR starts_with(b.real, '/r/' || c.tree || '/'), false) AS inside
FROM c LEFT JOIN b ON c.tree = b.tree AND c.rel = b.rel"""

MODULES = """
WITH h AS (
  SELECT DISTINCT page_id AS n, unnest(list_transform(regexp_extract_all(html, 'href="/?([^"]+)"', 1), lambda m: regexp_replace(m, '[^A-Za-z]', '_', 'g'))) AS m FROM pages),
i AS (
  SELECT *, length(m) % 4 AS k, CASE WHEN n % 3 = 0 THEN 'src/p' || n || '.py' ELSE 'src/p' || n || '.ts' END AS path,
         CASE WHEN n % 3 = 0 AND n % 2 = 1 THEN 'sub' WHEN n % 3 = 0 THEN 'py' WHEN n % 4 IN (0, 2) THEN 'rel' WHEN n % 4 = 1 THEN 'js' ELSE 'pkg' END AS kind FROM h),
x AS (
  SELECT *, CASE kind WHEN 'sub' THEN m || '.sub' WHEN 'rel' THEN CASE WHEN n % 4 = 0 THEN './' ELSE '../src/./' END || m WHEN 'js' THEN './' || m || '.js' ELSE m END AS module,
         CASE kind WHEN 'sub' THEN m IN ('the', 'und') OR k = 1 WHEN 'py' THEN m IN ('the', 'und') OR k = 0 WHEN 'rel' THEN k IN (0, 1) WHEN 'js' THEN k = 0 ELSE m IN ('the', 'de') OR k IN (0, 1) END AS base,
         k = 2 AND kind IN ('py', 'rel', 'js') AS more FROM i)
SELECT path, module, n % 2 = 1 AS introduced FROM x WHERE NOT (base OR more)"""

SCRIPTS = """
WITH l AS (SELECT ['#!/usr/bin/python3', '#!/usr/bin/env python3.11', '', '', '', '#! /opt/py/bin/python', '', ''] AS good,
                  ['/usr/bin/python3', 'python3.11', NULL, NULL, NULL, '/opt/py/bin/python', NULL, NULL] AS run),
c AS (
  SELECT c_custkey AS id, c_custkey % 50 AS u, c_custkey % 7 AS v, c_custkey % 13 AS t, (c_custkey % 50) * 13 + c_custkey % 13 AS h, (c_custkey % 7) * 13 + c_custkey % 13 AS g FROM customer),
f AS (
  SELECT *, h % 4 <> 0 AND h % 9 <> 0 AS in_home, g % 3 <> 0 AND g % 7 <> 0 AND id % 17 <> 0 AS in_opt, id % 11 = 0 OR id % 29 = 0 AS unknown FROM c),
r AS (
  SELECT id, CASE WHEN unknown THEN NULL WHEN in_home THEN run[h % 8 + 1] WHEN in_opt THEN run[(g + 3) % 8 + 1] END AS interpreter,
         CASE WHEN in_home THEN '/home/u' || u || '/bin/tool' || t ELSE '/opt/v' || v || '/bin/tool' || t END AS script FROM f, l)
SELECT id, CASE WHEN interpreter IS NOT NULL THEN script END AS script, interpreter FROM r"""

DIFFS = """
WITH d0 AS (
  SELECT doc_id AS n, 'c' || (doc_id // 4) AS change_id, 'f' || doc_id AS path, text,
         CASE WHEN suffix(text, chr(10)) THEN string_split(text, chr(10))[1:-2] ELSE string_split(text, chr(10)) END AS l0 FROM documents),
d1 AS (SELECT *, len(l0) AS m, (n % len(l0) + 1)::INT AS s FROM d0),
d2 AS (
  SELECT *, CASE WHEN n % 10 = 1 THEN '-- a/q' WHEN n % 131 = 0 THEN 'Subproject commit 1111111' ELSE l0[s] END AS x,
         CASE WHEN n % 101 = 0 THEN 'D' WHEN n % 103 = 0 THEN 'R' WHEN n % 107 = 0 THEN 'C' WHEN n % 109 = 0 THEN 'S' WHEN n % 113 = 0 THEN 'B' WHEN n % 97 = 0 THEN 'd' WHEN n % 89 = 0 THEN 'r' ELSE '' END AS kind,
         (s > 1)::INT AS lead, s - (s > 1)::INT + CASE WHEN n % 73 = 0 THEN 2 ELSE 0 END AS stated, text IS NOT NULL AND n % 59 = 0 AS zero FROM d1),
d3 AS (SELECT *, list_concat(list_append(l0[1:s - 1], x), l0[s + 1:]) AS ls FROM d2),
d4 AS (
  SELECT *, text IS NOT NULL AND kind NOT IN ('B', 'S') AND NOT zero AS usual, zero AND kind NOT IN ('B', 'S') AS loose, CASE WHEN n % 71 = 0 THEN list_concat(list_append(ls[1:s - 1], 'changed since'), ls[s + 1:]) ELSE ls END AS nb,
         ls[greatest(s - 1, 1):least(s + 1, m)] AS old, text IS NOT NULL AND n % 67 <> 0 AS readable FROM d3),
d AS (
  SELECT *, len(old) AS k, usual AND n % 2 = 0 AND s + 5 <= m AS more, usual AND n % 4 = 3 AND (n // 4) % 53 = 0 AS malformed,
         kind IN ('D', 'd') AS deleted, kind IN ('R', 'r') AS renamed, kind = 'C' AS copied, kind = 'S' AS submodule, kind = 'B' AS is_binary, kind <> 'B' AS has_hunks FROM d4),
p1 AS (SELECT *, CASE WHEN readable AND usual THEN list_filter(range(1, m - k + 2), lambda i: nb[i:i + k - 1] = old) ELSE [] END AS w1 FROM d),
p2 AS (SELECT *, CASE WHEN list_contains(w1, stated) THEN stated WHEN len(w1) = 1 THEN w1[1] END AS at1 FROM p1),
p3 AS (SELECT *, CASE WHEN more AND at1 IS NOT NULL THEN list_filter(range(at1 + k, m + 1), lambda i: nb[i] = ls[s + 5]) ELSE [] END AS w2 FROM p2),
p AS (
  SELECT *, CASE WHEN list_contains(w2, s + 5) THEN s + 5 WHEN len(w2) = 1 THEN w2[1] END AS at2 FROM p3),
q AS (
  SELECT *, CASE WHEN usual THEN at1 IS NOT NULL AND (NOT more OR at2 IS NOT NULL) ELSE kind <> 'S' END AS applies,
         CASE WHEN text IS NULL THEN '0' WHEN loose THEN CASE WHEN readable THEN (s - 1)::VARCHAR ELSE '0' END
              WHEN usual THEN coalesce((at1 - 1)::VARCHAR, '-') || CASE WHEN more THEN ',' || coalesce((at2 - 1)::VARCHAR, '-') ELSE '' END ELSE '-' END AS at_lines
  FROM p),
added AS (
  SELECT n, path, unnest(CASE WHEN text IS NULL THEN [1, 2] WHEN kind = 'S' THEN [1] WHEN loose THEN [s] WHEN more THEN [stated + lead, stated + lead + 1, s + 7] ELSE [stated + lead, stated + lead + 1] END)::INT AS line
  FROM d WHERE has_hunks)
"""

SQL = {
    "change_verdict": DOCS + """
, q AS (
  SELECT ru.*, ru.change_id IN (SELECT change_id FROM un) AS unk,
         NOT clc AND unc = 0 AND inert_files + removal_files = files AS acc FROM ru)
SELECT change_id, total, covered,
       CASE WHEN NOT unk AND clc AND gaps = 0 THEN 'SAFE' ELSE 'UNPROVEN' END AS verdict,
       CASE WHEN unk THEN 'COVERAGE_UNKNOWN' WHEN clc AND gaps = 0 THEN 'SAFE'
            WHEN NOT clc AND acc AND inert_files = 0 THEN 'REMOVAL_ONLY' WHEN NOT clc AND acc AND removal_files = 0 THEN 'INERT_ONLY' WHEN NOT clc AND acc THEN 'REMOVAL_AND_INERT'
            WHEN gaps = 1 THEN 'BRANCH_ONE' WHEN gaps > 1 THEN 'BRANCH_MANY'
            WHEN total > 0 AND covered > 0 THEN 'PARTIAL' ELSE 'NOT_EXERCISED' END AS reason_code
FROM q""",
    "explode_lines": DOCS + "SELECT doc_id, line AS line_no, inert AS is_inert FROM l",
    "statement_runs": DOCS + "SELECT change_id, path, rfirst, rlast, owner FROM runs",
    "owner_of_changed_line": DOCS + "SELECT path, line, owner FROM att",
    "first_seen_statement": DOCS + "SELECT path, stmt, first_line FROM st2",
    "attribution_by_file": DOCS + "SELECT path, statements, covered, excluded, gaps, had_lines FROM bf",
    "coverage_rule": DOCS + "SELECT change_id, clc AS changed_lines_covered, fwu AS files_with_uncovered, total FROM ru",
    "nothing_to_attest": DOCS + "SELECT change_id, inert_files, removal_files, NOT clc AND unc = 0 AND inert_files + removal_files = files AS all_accounted FROM ru",
    "partial_branch_gate": DOCS + "SELECT path, stmt FROM ss WHERE gap",
    "uncovered_fair_share": DOCS + "SELECT change_id, path, stmt, least(tot, 6) AS shown, tot AS total FROM sh",
    "missing_test_hints": DOCS + """
SELECT change_id, CASE WHEN exc THEN path || ':' || stmt || ' is excluded from coverage (e.g. `# pragma: no cover`, `if TYPE_CHECKING:`), so no test can exercise it; review this change by hand' ELSE 'add a test exercising ' || path || ':' || stmt END AS hint,
       least(tot, 4) AS shown, tot AS total
FROM (SELECT *, row_number() OVER (PARTITION BY change_id ORDER BY file_ord, first_line) AS rr FROM sh) WHERE rr <= 4""",
    "unmeasured_files": DOCS + "SELECT change_id, path FROM un",
    "python_only_gate": PAGES + """
, o AS (SELECT change_id, bool_and(path LIKE '%.py') AS all_python, coalesce(list_sort(list(path) FILTER (path NOT LIKE '%.py')), []) AS x FROM f GROUP BY change_id)
SELECT change_id, all_python, array_to_string(x[1:2], ', ') || CASE WHEN len(x) > 2 THEN ' and ' || (len(x) - 2) || ' more' ELSE '' END AS others FROM o""",
    "imports_introduced": REFS + "SELECT page_id, top AS module FROM i",
    "import_reasons_capped": REFS + """
, g AS (SELECT 'c' || (page_id // 3) AS change_id, list_sort(list(DISTINCT 'p' || page_id || ': ' || top)) AS x FROM i GROUP BY 1)
SELECT change_id, array_to_string(x[1:5], '; ') || CASE WHEN len(x) > 5 THEN ' and ' || (len(x) - 5) || ' more' ELSE '' END AS reason, len(x)::INT AS n FROM g""",
    "failure_ids_from_log": LOGS + "SELECT DISTINCT suite, test_id FROM f",
    "new_failures": LOGS + "SELECT DISTINCT suite, test_id FROM f WHERE event_id % 3 <> 0 EXCEPT SELECT suite, test_id FROM f WHERE event_id % 3 = 0",
    "failure_blocks": """
WITH m AS (
  SELECT conv_id, turn, list_concat(CASE WHEN turn % 4 = 1 THEN ['FAIL  t' || turn] WHEN turn % 6 = 5 THEN ['Test Files  1 failed'] ELSE [] END,
         CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END) AS ls FROM conversations),
c AS (SELECT conv_id, turn * 1000000000 + generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM m),
b AS (SELECT *, line LIKE 'FAIL  %' AS h, sum((line LIKE 'FAIL  %' OR line LIKE 'Test Files%')::INT) OVER (PARTITION BY conv_id ORDER BY pos) AS blk FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, blk ORDER BY pos) AS i FROM b WHERE blk > 0),
g AS (
  SELECT conv_id, blk, max(line) FILTER (i = 1 AND h) AS header, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (i BETWEEN 2 AND 11), '') AS message FROM n GROUP BY conv_id, blk)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY blk)::INT AS block, header, message FROM g WHERE header IS NOT NULL""",
    "last_attempt": RUNS + """
SELECT event_id // 4 AS suite, coalesce(min(event_id % 4) FILTER (code = 0), max(event_id % 4)) AS attempt, CASE WHEN min(code) = 0 THEN 'passed' ELSE 'failed' END AS outcome FROM e GROUP BY 1""",
    "tests_gate_decision": RUNS + """
, p AS (
  SELECT event_id // 3 AS change_id, min(code) FILTER (event_id % 3 = 0 AND event_id % 31 <> 0) AS b, min(code) FILTER (event_id % 3 = 1 AND event_id % 31 <> 0) AS a,
         min(code) FILTER (event_id % 3 = 2 AND event_id % 31 <> 0) AS r, list('t' || user_id) FILTER (event_id % 3 = 1 AND event_type = 'error') AS ids
  FROM e GROUP BY 1 HAVING count(*) FILTER (event_id % 31 <> 0) > 0),
w AS (
  SELECT *, CASE WHEN b IS NULL THEN 'NO_RUNNER' WHEN b <> 0 THEN 'BASELINE_RED' WHEN a = 0 THEN 'PASSED' WHEN ids IS NULL THEN 'UNREADABLE'
                 WHEN coalesce(r, 1) <> 0 THEN 'FAILED' ELSE 'FLAKY' END AS reason_code FROM p)
SELECT change_id, reason_code IN ('PASSED', 'FLAKY') AS passed, reason_code, CASE WHEN reason_code = 'FLAKY' THEN array_to_string(list_sort(list_distinct(ids)), ',') ELSE '' END AS flaky FROM w""",
    "stability_varied": RUNS + """
, v AS (
  SELECT event_id // 5 AS suite, count(DISTINCT CASE WHEN event_type = 'error' THEN 't' || user_id ELSE 'run ' || (event_id % 5) END) AS n
  FROM e WHERE code = 1 GROUP BY 1),
r AS (SELECT event_id // 5 AS suite, count(*) FILTER (event_type <> 'signup') AS runs, count(*) FILTER (event_type = 'signup') AS inconclusive FROM e GROUP BY 1)
SELECT r.suite, runs, coalesce(n, 0) AS varied, inconclusive FROM r LEFT JOIN v ON r.suite = v.suite""",
    "mutation_summary": MUTANTS + """
SELECT l_orderkey, count(*) FILTER (rn <= 3) AS tested, count(*) FILTER (rn <= 3 AND outcome = 'killed') AS killed, count(*) FILTER (rn <= 3 AND outcome = 'survived') AS survived,
       count(*) FILTER (rn <= 3 AND outcome = 'inconclusive') AS inconclusive, count(*) > 3 AS truncated FROM r GROUP BY l_orderkey""",
    "mutant_budget": MUTANTS + "SELECT l_orderkey, l_linenumber, l_partkey, kind, rn FROM r WHERE rn <= 3",
    "mutant_splice": DOCS + """
SELECT doc_id, line AS line_no, CASE WHEN (doc_id + line) % 3 <> 0 OR substr(txt, 3, 2) = '==' THEN substr(txt, 1, 2) || '<=' || substr(txt, 5) END AS mutated
FROM l WHERE length(txt) > 4""",
    "first_failed_gate": """
SELECT k AS o_orderkey, g AS gate, CASE WHEN g IS NULL THEN NULL WHEN k % 2 = 0 THEN g || ' broke' ELSE g || ' gate failed' END AS reason
FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 19 = 0 THEN 'syntax' WHEN o_orderkey % 17 = 0 THEN 'imports' WHEN o_orderkey % 5 = 0 THEN 'tests' END AS g FROM orders)""",
    "fuse_full": FUSED + "SELECT o_orderkey, verdict, reason_code, scope FROM v",
    "reason_precedence": FUSED + "SELECT reason_code, count(*) AS n FROM v GROUP BY reason_code",
    "exit_code": FUSED + "SELECT o_orderkey, CASE WHEN verdict = 'UNSAFE' THEN 1 ELSE 0 END AS exit_code FROM v",
    "test_file_flag": PAGES + """
, b AS (SELECT path, slashed, string_split(slashed, '/') AS parts, string_split(path, '/')[-1] AS raw FROM nf)
SELECT path, list_contains(parts, 'tests') OR list_contains(parts, 'test') OR regexp_matches(parts[-1], '^(conftest\\.py|test_.+\\.py|.*_test\\.py|.*\\.(test|spec)\\.[cm]?[jt]sx?)$') AS is_test,
       regexp_matches(raw, '^(test_.*|.*_test)\\.py$') AS is_discovered FROM b""",
    "normalise_path": PAGES + "SELECT path, norm AS normalised, NOT (slashed LIKE '../%') AS inside FROM nf",
    "diff_entry_flags": DIFFS + "SELECT path, deleted, renamed, copied, submodule, is_binary FROM d",
    "diff_refusal": DIFFS + """
, f AS (
  SELECT *, CASE WHEN NOT has_hunks THEN NULL WHEN text IS NOT NULL AND NOT readable THEN 'NOT_UTF8' WHEN loose THEN 'ZERO_CONTEXT' WHEN NOT applies THEN 'NOT_APPLIED' END AS own FROM q)
SELECT change_id, CASE WHEN bool_or(malformed) THEN 'MALFORMED' WHEN bool_or(deleted) THEN 'DELETE' WHEN bool_or(copied) THEN 'COPY' WHEN bool_or(renamed) THEN 'RENAME' WHEN bool_or(submodule) THEN 'SUBMODULE'
       WHEN count(own) > 0 THEN arg_min(own, n) FILTER (own IS NOT NULL) WHEN bool_or(is_binary) AND NOT bool_or(has_hunks) THEN 'BINARY_ONLY' WHEN bool_or(is_binary) THEN 'BINARY_MIXED'
       WHEN NOT bool_or(has_hunks) THEN 'NO_EDITS' END AS error_code FROM f GROUP BY change_id""",
    "hunk_places": DIFFS + "SELECT path, applies, at_lines FROM q WHERE has_hunks",
    "applied_edits": DIFFS + """
, w AS (
  SELECT *, CASE WHEN text IS NULL THEN ['new', 'file'] WHEN loose THEN list_concat(list_append(nb[1:s - 1], 'added'), nb[s:])
         ELSE list_concat(nb[1:at1 - 1], list_concat(list_concat(CASE WHEN lead = 1 THEN [ls[s - 1]] ELSE [] END, [CASE WHEN n % 10 = 1 THEN '++ b/q' ELSE 'new ' || x END, 'added']),
              list_concat(CASE WHEN s < m THEN [ls[s + 1]] ELSE [] END, CASE WHEN more THEN list_concat(nb[at1 + k:at2 - 1], list_concat([ls[s + 5], 'eleven'], nb[at2 + 1:])) ELSE nb[at1 + k:] END))) END AS made,
         CASE WHEN text IS NULL THEN true WHEN more AND at2 >= m THEN false WHEN usual AND NOT more AND at1 + k > m THEN true ELSE suffix(text, chr(10)) END AS newline
  FROM q WHERE has_hunks AND applies AND (text IS NULL OR readable)),
c AS (SELECT path, array_to_string(made, chr(10)) || CASE WHEN newline THEN chr(10) ELSE '' END AS t FROM w)
SELECT path, length(t)::INT AS size, md5(t) AS digest FROM c""",
    "hunk_new_lines": DIFFS + "SELECT path, line FROM added",
    "diff_files": DIFFS + "SELECT ((n // 4) % 8)::INT AS bundle, path, line FROM added WHERE (n // 4) % 53 <> 0",
    "coverage_json_sets": DOCS + """
SELECT path, line, CASE WHEN (doc_id * 17 + line * 7) % 11 <> 0 THEN 'executed' WHEN (doc_id * 5 + line * 3) % 4 = 0 THEN 'excluded' ELSE 'missing' END AS status FROM l""",
    "innermost_interval": """
WITH p AS (SELECT DISTINCT l_orderkey, unnest(range(1, 10))::INT AS point FROM lineitem)
SELECT p.l_orderkey, p.point, max(i.l_linenumber) AS owner FROM p JOIN lineitem i ON p.l_orderkey = i.l_orderkey
AND p.point BETWEEN i.l_linenumber AND i.l_linenumber + (i.l_quantity % 5)::INT GROUP BY ALL""",
    "outside_testpaths": PAGES + """
, t AS (SELECT DISTINCT change_id, CASE WHEN page_id % 2 = 0 THEN 'tests' ELSE 'src' END AS dir FROM nf WHERE page_id % 4 <> 3),
x AS (SELECT change_id, regexp_replace(replace(path, '\\', '/'), '^\\./', '') AS file FROM nf)
SELECT change_id, file FROM x WHERE change_id IN (SELECT change_id FROM t)
AND NOT EXISTS (SELECT 1 FROM t WHERE t.change_id = x.change_id AND (x.file = dir OR starts_with(x.file, dir || '/')))""",
    "env_kept": """
WITH n AS (SELECT upper(replace(n_name, ' ', '_')) || unnest(['_TOKEN', '_TOKENIZER', '_API_KEY', '_HOME', '_SECRET']) AS name FROM nation)
SELECT name, NOT (name LIKE '%\\_TOKEN' ESCAPE '\\' OR name LIKE '%\\_API\\_KEY' ESCAPE '\\' OR name LIKE '%\\_SECRET' ESCAPE '\\') AS kept FROM n""",
    "runner_choice": PAGES + """
SELECT host, CASE WHEN bool_or(page_id % 6 = 3) THEN 'vitest' WHEN bool_or(page_id % 6 = 0) THEN 'jest' WHEN bool_or(page_id % 6 IN (1, 4, 5)) THEN 'pytest' END AS runner FROM p GROUP BY host""",
    "report_reason": DOCS + """
, q AS (
  SELECT ru.*, ru.change_id IN (SELECT change_id FROM un) AS unk, NOT clc AND unc = 0 AND inert_files + removal_files = files AS acc FROM ru),
gp AS (SELECT change_id, arg_min(path || ':' || stmt, file_ord * 1000000 + first_line) AS g FROM ss WHERE gap GROUP BY change_id),
n AS (SELECT change_id, count(*)::INT AS listed, max(tot) AS tot FROM sh GROUP BY change_id)
SELECT q.change_id, CASE WHEN NOT unk AND clc AND gaps = 0 THEN 'SAFE' ELSE 'UNPROVEN' END AS verdict,
       CASE WHEN unk THEN 'Tests pass, but coverage of the changed code could not be determined.' WHEN clc AND gaps = 0 THEN 'Tests pass and the changed code is covered.'
            WHEN NOT clc AND acc AND inert_files = 0 THEN 'Tests pass. The change only removes code; there are no added lines for coverage to attest.'
            WHEN NOT clc AND acc AND removal_files = 0 THEN 'Tests pass. The change only touches comments and blank lines; there are no added statements for coverage to attest.'
            WHEN NOT clc AND acc THEN 'Tests pass. The change only removes code and touches comments and blank lines; there are no added statements for coverage to attest.'
            WHEN gaps = 1 THEN 'Tests pass, but a changed conditional has a branch no test took (' || gp.g || '). Add a test that enters the other branch.'
            WHEN gaps > 1 THEN 'Tests pass, but ' || gaps || ' changed conditionals have a branch no test took. Add tests that enter the untaken branches.'
            WHEN total > 0 AND covered > 0 THEN 'Tests pass, but only ' || covered || ' of ' || total || ' changed statements were exercised.'
            ELSE 'Tests pass, but the changed code is not exercised by any test.' END AS reason,
       files::INT AS files, coalesce(n.listed, 0) AS listed,
       CASE WHEN NOT (NOT unk AND clc AND gaps = 0) AND n.tot > 4 THEN n.tot END AS total
FROM q LEFT JOIN n ON q.change_id = n.change_id LEFT JOIN gp ON q.change_id = gp.change_id""",
    "walked_tests": PAGES + """
, x AS (
  SELECT host, CASE WHEN page_id % 9 = 0 THEN 'node_modules/' WHEN page_id % 10 = 0 THEN '.hidden/' ELSE '' END || regexp_replace(replace(path, '\\', '/'), '^\\./', '') AS pp, page_id FROM nf),
v AS (
  SELECT host, pp, string_split(pp, '/') AS parts, string_split(pp, '/')[1] IN ('node_modules', '.hidden', '..') AS gone, regexp_matches(string_split(pp, '/')[-1], '^(test_.*|.*_test)\\.py$') AS test FROM x),
o AS (SELECT *, CASE WHEN gone THEN parts[1:1] ELSE parts END AS visited, test AND NOT gone AS counts FROM v),
r AS (SELECT *, CASE WHEN counts THEN row_number() OVER (PARTITION BY host, counts ORDER BY parts) END AS k FROM o),
g AS (SELECT host, list(pp ORDER BY parts) FILTER (k <= 3) AS t, max(visited) AS last, max(parts) FILTER (k = 3) AS third FROM r GROUP BY host)
SELECT host, CASE WHEN NOT coalesce(last > third, false) THEN coalesce(array_to_string(t, ','), '') END AS tests, coalesce(last > third, false) AS truncated FROM g""",
    "gated_checks": CHECKED + "SELECT o_orderkey, verdict, reason_code, scope FROM v",
    "path_containment": LINKS,
    "unresolved_imports": MODULES,
    "console_script": SCRIPTS,
    "coverage_damaged": DOCS + """
, k AS (SELECT *, doc_id % 19 = 0 OR doc_id % 23 = 0 OR doc_id % 29 = 0 OR doc_id % 31 = 0 OR doc_id % 37 = 0 OR doc_id % 41 = 0 AS damaged FROM l)
SELECT path, line, CASE WHEN (doc_id * 17 + line * 7) % 11 <> 0 THEN 'executed' WHEN (doc_id * 5 + line * 3) % 4 = 0 THEN 'excluded' ELSE 'missing' END AS status FROM k WHERE NOT damaged
UNION ALL SELECT DISTINCT path, NULL::INT, 'unknown' FROM k WHERE damaged""",
    "environments": """
WITH e AS (
  SELECT event_id, json_extract_string(props, '$.k') AS k, user_id, repeat('é', (event_id % 5000)::INT) || '<' || user_id || '>' || chr(10) || CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END AS said FROM events)
SELECT event_id, array_to_string(list_sort(list_concat(['HOME', 'K' || k], CASE WHEN event_id % 2 = 0 THEN [] ELSE ['U' || user_id || '_SECRETS'] END)), ',') AS kept, right(said, 4000) AS tail FROM e""",
    "mutant_outcomes": MUTANTS + """
, w AS (SELECT l_orderkey, l_linenumber, l_partkey, bool_or(outcome = 'survived' AND l_partkey % 7 <> 0) OR l_partkey % 3 = 0 AS s, bool_or(outcome = 'inconclusive') AS i FROM m GROUP BY l_orderkey, l_linenumber, l_partkey)
SELECT m.l_orderkey, count(*) FILTER (NOT s AND NOT i AND m.l_partkey % 7 <> 0) AS killed, count(*) FILTER (s) AS survived, count(*) FILTER (NOT s AND (i OR m.l_partkey % 7 = 0)) AS inconclusive
FROM m JOIN w ON m.l_orderkey = w.l_orderkey AND m.l_linenumber = w.l_linenumber AND m.l_partkey = w.l_partkey GROUP BY m.l_orderkey""",
    "stability_outcomes": RUNS + """
SELECT event_id // 5 AS suite, array_to_string(list_sort(list(DISTINCT CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 't' || (user_id % 9) ELSE 'run ' || (event_id % 5) || ' (seed ' || user_id || ')' END)), ', ') AS varied
FROM e WHERE code = 1 GROUP BY 1""",
    "command_exit": FUSED + "SELECT o_orderkey, CASE WHEN o_orderkey % 43 = 0 OR o_orderkey % 41 = 0 THEN 7 WHEN o_orderkey % 37 = 0 THEN 2 WHEN verdict = 'UNSAFE' THEN 1 ELSE 0 END AS exit_code FROM v",
    "language_gates": PAGES + """
, g AS (SELECT host, CASE WHEN path LIKE '%.py' THEN 1 ELSE 2 END AS o, CASE WHEN length(html) % 3 <> 0 THEN 'bad ' || path END AS r FROM f WHERE regexp_matches(path, '\\.(py|ts|tsx|js|jsx)$')),
x AS (SELECT host, coalesce(list_transform(list_sort(list(DISTINCT {'o': o, 'r': r}) FILTER (r IS NOT NULL)), lambda v: v.r), []) AS x FROM g GROUP BY host)
SELECT host, len(x) = 0 AS passed, x[1] AS reason, array_to_string(x[1:2], '; ') || CASE WHEN len(x) > 2 THEN ' and ' || (len(x) - 2) || ' more' ELSE '' END AS reasons FROM x""",
    "report_notes": """
WITH k AS (SELECT o_orderkey, o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN '-k; a b' ELSE '' END AS sg FROM orders),
n AS (
  SELECT o_orderkey, CASE WHEN k % 3 = 1 THEN '  note: the test command narrowed the suite (' || sg || '), so this run cannot be SAFE. Re-run without the filter to get a verdict on the whole suite.'
           WHEN k % 3 = 2 AND k % 7 < 4 THEN '  note: could not determine whether the test command runs the whole suite' || CASE WHEN sg <> '' THEN ' (' || sg || ')' ELSE '' END || '; the verdict assumes it does.' END AS a,
         CASE WHEN k % 5 > 0 THEN 'note: ' || (k % 5) || ' test(s) flipped on retry and were treated as flaky: ' || ['t1', 't1, t2', 't1, t2, t3', 't1, t2, t3, ...'][(k % 5)::INT] END AS b,
         CASE WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN 'note: --mutate did not run (' || CASE WHEN k % 2 = 0 THEN 'no tests' ELSE 'no conclusion' END || '); this verdict is not mutation-checked'
              WHEN k % 4 = 0 THEN 'note: --mutate found no mutable operators or constants in the changed statements; nothing to check'
              WHEN k % 6 = 0 OR k % 8 > 0 THEN 'note: --mutate was incomplete — ' || concat_ws('; ', CASE WHEN k % 6 = 0 THEN 'only ' || (k % 4) || ' of ' || (k % 4 + 9) || ' mutants were run (budget)' END, CASE WHEN k % 8 > 0 THEN (k % 8) || ' inconclusive (skipped)' END) || '; a surviving mutant could have been missed' END AS c,
         CASE WHEN k % 17 = 0 THEN NULL WHEN k % 19 = 0 THEN 'note: --flaky-check did not run (no conclusion); this verdict is not stability-checked'
              WHEN k % 3 = 0 AND k % 2 = 0 AND k % 5 > 0 THEN 'note: --flaky-check reran the suite but every rerun was inconclusive (' || (k % 5) || ' timed out); flakiness could have been missed' END AS d FROM k)
SELECT o_orderkey, concat_ws(chr(10), a, b, c, d) AS notes FROM n""",
    "unresolved_log": "SELECT event_id AS change_id, 'f' || (event_id % 50) AS path, 'm' || user_id AS module FROM events WHERE event_type = 'error' AND event_id % 13 <> 0",
    "helper_accounting": "SELECT 'c' || (doc_id // 4) AS change_id, 'f' || doc_id AS path, CASE WHEN doc_id % 17 = 3 THEN 'SyntaxError' WHEN doc_id % 23 = 4 THEN 'no answer' END AS error FROM documents WHERE text IS NOT NULL",
    "coverage_availability": DOCS + """
, k AS (
  SELECT change_id, min(doc_id // 4) AS k, list_sort(list(path || '.ts') FILTER (doc_id % 29 = 0)) AS o, count(*) FILTER (doc_id % 29 <> 0) AS py, bool_or(doc_id % 53 = 0) AS m FROM d GROUP BY change_id)
SELECT change_id, CASE WHEN o IS NOT NULL THEN 'OTHER_LANGUAGES' WHEN py = 0 THEN 'NO_PYTHON' WHEN k % 31 = 1 OR k % 13 = 2 THEN 'TOOL_MISSING'
       WHEN k % 11 = 3 THEN CASE WHEN k % 2 = 0 THEN 'REPORT_FAILED' ELSE 'RUN_FAILED' END WHEN change_id IN (SELECT change_id FROM un) THEN 'NOT_IMPORTED'
       WHEN m THEN 'EXTENTS_FILE_ERROR' END AS unknown_code, array_to_string(o, ', ') AS others FROM k""",
    "edits_or_diff": """
WITH d AS (SELECT doc_id, 'c' || (doc_id // 4) AS change_id, 'f' || doc_id AS path, length(text)::INT AS size FROM documents WHERE text IS NOT NULL),
g AS (SELECT change_id, path, 'edits' AS origin, size FROM d WHERE doc_id % 5 = 0)
SELECT * FROM g UNION ALL SELECT change_id, path, 'diff', size FROM d WHERE doc_id % 7 <> 0 AND change_id NOT IN (SELECT change_id FROM g)""",
}

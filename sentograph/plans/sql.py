"""Parts of the SQL that the queries' results are compared with."""

import re

OB = r"ob AS (SELECT l_orderkey AS id, list(replace(p_brand, 'Brand#', 'B') ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS tokens FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)"
EV = r"ev AS (SELECT user_id AS id, list(event_type ORDER BY ts, event_id) AS tokens FROM events GROUP BY user_id)"
DOC = r"doc AS (SELECT doc_id AS id, lang, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f\v]+'), lambda x: x <> '') AS tokens FROM documents)"


def windows(corpus: str, longest: int, keep: str = "") -> str:
    """w(id, ngram, n): all occurrences; p: distinct; s: support."""
    return (
        f"w AS (SELECT id, {keep} array_to_string(tokens[i:i + k - 1], '|') AS ngram, CAST(k AS BIGINT) AS n FROM {corpus}, unnest(range(1, len(tokens) + 1)) a(i), unnest(range(1, least({longest}, len(tokens) - i + 1) + 1)) b(k)), "
        "p AS (SELECT DISTINCT id, ngram, n FROM w), s AS (SELECT ngram, n, count(*) AS support FROM p GROUP BY ngram, n)"
    )


CLOSED = (
    r"par AS (SELECT regexp_replace(ngram, '\|[^|]*$', '') AS sub, support FROM s WHERE n > 1 UNION SELECT regexp_replace(ngram, '^[^|]*\|', ''), support FROM s WHERE n > 1), "
    "c AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM par WHERE par.sub = s.ngram AND par.support = s.support))"
)
EDGES = (
    "sub AS (SELECT DISTINCT ngram, support, array_to_string(t[i:i + k - 1], '|') AS sub FROM (SELECT *, string_split(ngram, '|') AS t FROM c), unnest(range(1, n + 1)) x(i), unnest(range(1, n - i + 2)) y(k) WHERE k < n), "
    "e AS (SELECT c.ngram AS src, sub.ngram AS dst, sub.support AS weight FROM sub JOIN c ON c.ngram = sub.sub)"
)
UNDIRECTED = "u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e)"


def distances(deep: int = 8) -> str:
    """d(src, dst, d): shortest path lengths; walks of up to that many steps are looked at."""
    return f"walk(src, dst, d) AS (SELECT ngram, ngram, CAST(0 AS BIGINT) FROM c UNION SELECT walk.src, u.b, walk.d + 1 FROM walk JOIN u ON walk.dst = u.a WHERE walk.d < {deep}), d AS (SELECT src, dst, min(d) AS d FROM walk GROUP BY src, dst)"


COMPONENTS = "comp AS (SELECT src AS node, min(dst) AS component FROM d GROUP BY src), diam AS (SELECT component, count(*) AS size, max(far) AS diameter FROM (SELECT comp.node, component, max(d) AS far FROM comp JOIN d ON d.src = comp.node GROUP BY comp.node, component) GROUP BY component HAVING count(*) > 1), pen AS (SELECT node, coalesce(diameter, 0) + 1 AS far, diameter IS NULL AS isolated FROM comp LEFT JOIN diam USING (component))"
DEG = "deg AS (SELECT o_orderkey AS id, o_orderstatus AS contrast, ln(o_totalprice / avg(o_totalprice) OVER ()) / ln(2) AS log2fc, (rank() OVER (ORDER BY abs(o_totalprice - avg_price) DESC))::DOUBLE / count(*) OVER () AS padj FROM (SELECT *, avg(o_totalprice) OVER () AS avg_price FROM orders) WHERE o_totalprice > 0)"
SETS = "ug AS (SELECT user_id AS id, avg(value) AS v FROM events GROUP BY user_id), mem AS (SELECT CASE WHEN v > (SELECT avg(value) FROM events) THEN 'up' ELSE 'down' END AS side, id FROM ug)"
SIDE_NODES = (
    "own AS (SELECT side, p.ngram, count(*) AS k FROM p JOIN c USING (ngram) JOIN mem USING (id) GROUP BY side, p.ngram), "
    "sn AS (SELECT side, ngram AS node FROM own o WHERE NOT EXISTS (SELECT 1 FROM e JOIN own l ON l.ngram = e.dst WHERE e.src = o.ngram AND l.side = o.side AND l.k = o.k))"
)
SEPARATION = (
    "near AS (SELECT g.side, g.node, min(d.d) AS d FROM sn g LEFT JOIN (SELECT d.src, d.d, t.side FROM d JOIN sn t ON t.node = d.dst WHERE d.d > 0) d ON d.src = g.node AND d.side = g.side GROUP BY g.side, g.node), "
    "inn AS (SELECT side, sum(CASE WHEN isolated THEN 0 ELSE coalesce(d, 0) END)::DOUBLE / count(*) AS m FROM near JOIN pen USING (node) GROUP BY side), "
    "one AS (SELECT * FROM sn WHERE node NOT IN (SELECT node FROM sn GROUP BY node HAVING count(*) > 1)), "
    "acr AS (SELECT one.node, min(d.d) AS d FROM one LEFT JOIN (SELECT d.src, d.d, t.side FROM d JOIN sn t ON t.node = d.dst WHERE d.d > 0) d ON d.src = one.node AND d.side <> one.side GROUP BY one.node), "
    "acs AS (SELECT coalesce(sum(CASE WHEN isolated THEN 1 ELSE coalesce(d, far) END), 0)::DOUBLE AS t FROM acr JOIN pen USING (node))"
)


def hyper(k: str, n: str, m: str, total: str) -> str:
    """The upper tail of the hypergeometric distribution."""
    t = f"lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + lgamma({total} - {n} + 1) - lgamma({m} - i + 1) - lgamma({total} - {n} - {m} + i + 1) - lgamma({total} + 1) + lgamma({m} + 1) + lgamma({total} - {m} + 1)"
    return f"CASE WHEN {k} = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, list_sum(list_transform(list_filter(range({k}, least({n}, {m}) + 1), lambda i: {total} - {n} - {m} + i >= 0), lambda i: exp({t})))) END"


def up_to(p: str, limit: str) -> str:
    """p <= limit for computed probabilities, whose last digits don't count."""
    return f"{p} <= {limit} * (1 + 1e-9::DOUBLE)"


def below(p: str, limit: str) -> str:
    return f"{p} < {limit} * (1 - 1e-9::DOUBLE)"


def two_sided(z: str) -> str:
    """The two-sided p of a standard normal value z >= 0, up to 6 or so."""
    return f"greatest(0, least(1, 1 - 2 * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 150), lambda k: exp((2 * k + 1) * ln(greatest({z}, 1e-9)) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1)))))))"


def numbered_paths(nodes: str, deep: int) -> str:
    """sp(src, dst, d, n): shortest path lengths and how many such paths there are, level by level over the edges u(a, b)."""
    parts = [f"l0 AS (SELECT node AS src, node AS dst, 0 AS d, 1.0::DOUBLE AS n FROM {nodes})"]
    for k in range(1, deep + 1):
        seen = " UNION ALL ".join(f"SELECT src, dst FROM l{j}" for j in range(k))
        parts.append(f"l{k} AS (SELECT l.src, u.b AS dst, {k} AS d, sum(l.n) AS n FROM l{k - 1} l JOIN u ON u.a = l.dst WHERE (l.src, u.b) NOT IN ({seen}) GROUP BY 1, 2)")
    return ", ".join(parts) + ", sp AS (" + " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(deep + 1)) + ")"


BETWEENNESS = (
    "pr AS (SELECT a.dst AS node, sum(a.n * b.n / c.n) AS s FROM sp a JOIN sp b ON b.src = a.dst JOIN sp c ON c.src = a.src AND c.dst = b.dst AND c.d = a.d + b.d WHERE a.src < b.dst AND a.dst <> a.src AND a.dst <> b.dst GROUP BY 1), "
    "bc AS (SELECT node, coalesce(s, 0) * 2 / ((count(*) OVER () - 1) * (count(*) OVER () - 2)) AS betweenness FROM nd LEFT JOIN pr USING (node))"
)


#: town(t, side, ngram, k) and tsn: the n-grams of each side of trials tmem(t, side, id), and those that a longer one with the same entities doesn't contain.
TRIAL_NGRAMS = (
    "town AS (SELECT t, side, p.ngram, count(*) AS k FROM p JOIN c USING (ngram) JOIN tmem USING (id) GROUP BY t, side, p.ngram)",
    "tsn AS (SELECT o.* FROM town o WHERE NOT EXISTS (SELECT 1 FROM e JOIN town l ON l.ngram = e.dst WHERE e.src = o.ngram AND l.t = o.t AND l.side = o.side AND l.k = o.k))",
)


def trial_metrics(sweep: tuple[float, ...]) -> tuple[str, ...]:
    """tm(t, separation, iqr) of trials tmem(t, side, id): the separation of each, and the quartiles' distance over those of the n-grams with p up to each cutoff. Over p, c, e, d, pen, ev."""
    cutoffs = ", ".join(f"{c!r}::DOUBLE" for c in sweep)
    return (
        *TRIAL_NGRAMS,
        "tsz AS (SELECT t, side, count(DISTINCT id) AS m FROM tmem GROUP BY t, side)",
        f"tsp AS (SELECT t, side, ngram AS node, {hyper('k', 'support', 'm', 'total')} AS p FROM (SELECT tsn.*, support, m, (SELECT count(*) FROM ev) AS total FROM tsn JOIN c USING (ngram) JOIN tsz USING (t, side)))",
        f"t3 AS (SELECT t, -1.0::DOUBLE AS cut, side, node FROM tsp UNION ALL SELECT t, cut, side, node FROM tsp, unnest([{cutoffs}]) x(cut) WHERE {up_to('p', 'cut')})",
        *separations("t3", "tsep", "t, cut"),
        "tm AS (SELECT t, max(separation) FILTER (WHERE cut < 0) AS separation, quantile_cont(separation, 0.75) FILTER (WHERE cut >= 0) - quantile_cont(separation, 0.25) FILTER (WHERE cut >= 0) AS iqr FROM (SELECT DISTINCT t FROM tmem) LEFT JOIN tsep USING (t) GROUP BY t)",
    )


def separations(rows: str, out: str, key: str, fixed: str = "far") -> tuple[str, ...]:
    """out(key, separation) of the sides of nodes in rows(key, side, node), by d and pen. fixed: the distance of a node that reaches none."""
    on = lambda a, b: " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in key.split(","))
    own = lambda a: ", ".join(f"{a}.{k.strip()}" for k in key.split(","))
    return (
        f"{out}_near AS (SELECT {own('g')}, g.side, g.node, min(d.d) AS d FROM {rows} g LEFT JOIN (SELECT d.src, d.d, r.* FROM d JOIN {rows} r ON r.node = d.dst WHERE d.d > 0) d ON d.src = g.node AND d.side = g.side AND {on('d', 'g')} GROUP BY {own('g')}, g.side, g.node)",
        f"{out}_in AS (SELECT {key}, side, sum(CASE WHEN isolated THEN 0 ELSE coalesce(d, 0) END)::DOUBLE / count(*) AS m, count(*) AS n FROM {out}_near JOIN pen USING (node) GROUP BY {key}, side)",
        f"{out}_one AS (SELECT {key}, min(side) AS side, node FROM {rows} GROUP BY {key}, node HAVING count(*) = 1)",
        f"{out}_to AS (SELECT {own('g')}, g.node, min(d.d) AS d FROM {out}_one g LEFT JOIN (SELECT d.src, d.d, r.* FROM d JOIN {rows} r ON r.node = d.dst WHERE d.d > 0) d ON d.src = g.node AND d.side <> g.side AND {on('d', 'g')} GROUP BY {own('g')}, g.node)",
        f"{out}_sum AS (SELECT {key}, sum(CASE WHEN isolated THEN 1 ELSE coalesce(d, {fixed}) END)::DOUBLE AS s FROM {out}_to JOIN pen USING (node) GROUP BY {key})",
        f"{out} AS (SELECT i.*, coalesce(s, 0) / n - m / 2 AS separation FROM (SELECT {key}, sum(m) AS m, sum(n) AS n FROM {out}_in GROUP BY {key} HAVING count(*) = 2) i LEFT JOIN {out}_sum USING ({key}))",
    )


def stability_trials(pairs: str, trials: int, seed: int) -> tuple[str, ...]:
    """tmem(t, side, id) of the trials 'of|random|trial' and 'of|subsample|trial' for pairs(pof, side, id); lengths are those of ev."""
    return (
        "lens AS (SELECT id, least(len(tokens), 11) AS length FROM ev)",
        f"wt AS (SELECT pof, length, round(count(*) * 0.7::DOUBLE) AS weight FROM {pairs} JOIN lens USING (id) GROUP BY pof, length)",
        f"wr AS (SELECT pof, pof || '|random|' || r AS t, r, length, weight FROM wt, range({trials}) x(r))",
        f"tk AS (SELECT *, (floor(0.85::DOUBLE * weight) + floor(('0x' || substr(md5('{seed}|' || t || '|' || length), 1, 8))::BIGINT / 4294967296.0::DOUBLE * greatest(ceil(1.15::DOUBLE * weight) - floor(0.85::DOUBLE * weight), 1)))::BIGINT AS take FROM wr)",
        f"chosen AS (SELECT pof, t, r, id FROM (SELECT pof, t, r, id, take, row_number() OVER (PARTITION BY t, length ORDER BY md5('{seed}|' || t || '|' || length || '|' || id), id) AS place FROM tk JOIN lens USING (length)) WHERE place <= take)",
        f"ups AS (SELECT pof, count(*) FILTER (WHERE side = 'up') / count(*)::DOUBLE AS ups FROM {pairs} GROUP BY pof)",
        "tsize AS (SELECT pof, t, r, count(*) AS size, floor(count(*) * any_value(ups))::BIGINT AS n_up FROM chosen JOIN ups USING (pof) GROUP BY pof, t, r)",
        f"rnd AS (SELECT t, id, CASE WHEN row_number() OVER (PARTITION BY t ORDER BY md5('split{seed}|' || t || '|' || id), id) <= n_up THEN 'up' ELSE 'down' END AS side FROM chosen JOIN tsize USING (pof, t, r))",
        f"subs AS (SELECT t, side, id FROM (SELECT pof || '|subsample|' || r AS t, side, id, CASE side WHEN 'up' THEN n_up ELSE size - n_up END AS take, row_number() OVER (PARTITION BY pof, r, side ORDER BY md5('sub{seed}|' || pof || '|subsample|' || r || '|' || side || '|' || id), id) AS place FROM {pairs} JOIN tsize USING (pof)) WHERE place <= take)",
        "tmem AS (SELECT t, side, id FROM rnd UNION ALL SELECT t, side, id FROM subs)",
    )


def stability_tests(out: str) -> tuple[str, ...]:
    """out(pof, separation_p, iqr_p): whether the random and subsampled trials of tm differ, by rank."""
    parts = ["tv AS (SELECT split_part(t, '|', 1) AS pof, split_part(t, '|', 2) AS kind, m, round(CASE m WHEN 's' THEN separation ELSE iqr END, 9) AS v FROM tm, unnest(['s', 'i']) x(m))"]
    parts.append("tr AS (SELECT *, rank() OVER (PARTITION BY pof, m ORDER BY v) + (count(*) OVER (PARTITION BY pof, m, v) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY pof, m, v) AS same FROM tv WHERE v IS NOT NULL)")
    parts.append("ta AS (SELECT pof, m, sum(rk) FILTER (WHERE kind = 'random') AS r, (count(*) FILTER (WHERE kind = 'random'))::DOUBLE AS x, (count(*) FILTER (WHERE kind = 'subsample'))::DOUBLE AS y, sum(same::DOUBLE * same - 1) AS ties FROM tr GROUP BY pof, m)")
    parts.append("tz AS (SELECT pof, m, greatest(0, (abs(r - x * (x + 1) / 2 - x * y / 2) - 0.5) / nullif(sqrt(x * y / 12 * (x + y + 1 - ties / ((x + y) * (x + y - 1)))), 0)) AS z FROM ta)")
    p = lambda m: f"max(CASE WHEN m = '{m}' THEN {two_sided('z')} END)"
    return (*parts, f"{out} AS (SELECT pof, {p('s')} AS separation_p, {p('i')} AS iqr_p FROM tz GROUP BY pof)")


def random_pairs(size: int, sets: int, seed: int, split: int, up_share: float, ids: str = "ev") -> str:
    """Rows (r, side, id) of random sets of ``size`` entities, the first share of them, in another order, as up."""
    drawn = f"SELECT r, id FROM (SELECT r, id, row_number() OVER (PARTITION BY r ORDER BY md5('{seed}|' || r || '|' || id), id) AS place FROM {ids}, range({sets}) x(r)) WHERE place <= {size}"
    return f"SELECT r, CASE WHEN row_number() OVER (PARTITION BY r ORDER BY md5('split{split}|' || r || '|' || id), id) <= floor(count(*) OVER (PARTITION BY r) * {up_share}::DOUBLE) THEN 'up' ELSE 'down' END AS side, id FROM ({drawn})"


def again(parts: tuple[str, ...], suffix: str) -> tuple[str, ...]:
    """The trials' steps under names of their own, to stand beside another set of trials."""
    names = r"\b(lens|wt|wr|tk|chosen|ups|tsize|rnd|subs|tmem|town|tsn|tsz|tsp|t3|tsep\w*|tm|tv|tr|ta|tz)\b(?! *\()"
    return tuple(re.sub(names, lambda m: m[1] + suffix, p) for p in parts)


def shapes(nodes: str, links: str) -> tuple[str, ...]:
    """shape(k, components, isolates, articulation) of the graphs nodes(k, node) with links(k, a, b) both ways, by leaving out each node in turn."""
    return (
        f"reach(k, src, dst) AS (SELECT k, node, node FROM {nodes} UNION SELECT r.k, r.src, l.b FROM reach r JOIN {links} l ON l.k = r.k AND l.a = r.dst)",
        f"left_out(k, v, dst) AS (SELECT k, a, min(b) FROM {links} GROUP BY k, a UNION SELECT r.k, r.v, l.b FROM left_out r JOIN {links} l ON l.k = r.k AND l.a = r.dst AND l.b <> r.v)",
        f"points AS (SELECT k, count(DISTINCT a) AS articulation FROM {links} l WHERE NOT EXISTS (SELECT 1 FROM left_out r WHERE r.k = l.k AND r.v = l.a AND r.dst = l.b) GROUP BY k)",
        "whole AS (SELECT k, count(*) FILTER (WHERE n = 1) AS isolates, count(DISTINCT m) AS components FROM (SELECT k, src, min(dst) AS m, count(*) AS n FROM reach GROUP BY k, src) GROUP BY k)",
        "shape AS (SELECT k, components, isolates, coalesce(articulation, 0) AS articulation FROM whole LEFT JOIN points USING (k))",
    )


def impact(group: str) -> str:
    """What sequences fu(id, tokens) change in the network c. group: SQL for what an n-gram's component lies within; only graphs of such groups that a sequence touches are looked at."""
    inner = r"regexp_replace(l.ngram, '\|[^|]*$', '') = m.ngram OR regexp_replace(l.ngram, '^[^|]*\|', '') = m.ngram"
    steps = (
        "rep AS (SELECT min(id) AS id, tokens, count(*) AS copies FROM fu GROUP BY tokens)",
        "fw AS (SELECT DISTINCT id, array_to_string(tokens[i:i + k - 1], '|') AS ngram, k AS n FROM rep, unnest(range(1, len(tokens) + 1)) a(i), unnest(range(1, least(3, len(tokens) - i + 1) + 1)) b(k) WHERE array_to_string(tokens, '|') NOT IN (SELECT ngram FROM c))",
        "mi AS (SELECT * FROM fw WHERE ngram NOT IN (SELECT ngram FROM c))",
        f"fresh AS (SELECT id, ngram FROM mi m WHERE NOT EXISTS (SELECT 1 FROM mi l WHERE l.id = m.id AND l.n = m.n + 1 AND ({inner})))",
        f"touch AS (SELECT DISTINCT id, {group.format('token')} AS g FROM (SELECT id, unnest(string_split(ngram, '|')) AS token FROM fresh))",
        f"gn AS (SELECT id || ':0' AS k, ngram AS node FROM touch JOIN c ON {group.format('c.ngram')} = g UNION ALL SELECT id || ':1', ngram FROM touch JOIN c ON {group.format('c.ngram')} = g UNION ALL SELECT id || ':1', ngram FROM fresh)",
        "sub_of AS (SELECT x.k, x.node AS a, y.node AS b FROM gn x JOIN gn y ON x.k = y.k AND x.node <> y.node AND contains('|' || y.node || '|', '|' || x.node || '|'))",
        "gl AS (SELECT k, a, b FROM sub_of UNION SELECT k, b, a FROM sub_of)",
        *shapes("gn", "gl"),
        "ch AS (SELECT rep.id, copies, (SELECT count(*) FROM fresh f WHERE f.id = rep.id) AS new, coalesce(x.components, 0) - y.components AS d_components, coalesce(x.isolates, 0) - y.isolates AS d_isolates, coalesce(x.articulation, 0) - y.articulation AS d_articulation FROM rep JOIN shape y ON y.k = rep.id || ':1' LEFT JOIN shape x ON x.k = rep.id || ':0')",
    )
    kind = "CASE WHEN d_components = 0 AND d_articulation = 0 THEN 'no change' WHEN d_components > 0 AND d_articulation <= 0 THEN 'joins components' WHEN d_components < 0 AND d_articulation = 0 THEN 'adds a component' WHEN d_components = 0 AND d_articulation > 0 THEN 'adds redundancy' WHEN d_components = 0 AND d_articulation < 0 THEN 'adds a bridge' ELSE 'unclassified' END"
    return ", ".join(steps) + f" SELECT *, {kind} AS category FROM ch"


def cox(rows: str, covariates: tuple[str, ...], penalizer: float, steps: int) -> tuple[str, ...]:
    """beta<steps> of so many Newton steps for two covariates of rows(duration, event, ...), each tied death by itself."""
    x, y = covariates
    parts = {"0": "r", "1": f"r * {x}", "2": f"r * {y}", "11": f"r * {x} * {x}", "12": f"r * {x} * {y}", "22": f"r * {y} * {y}"}
    out = ["beta0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)", f"many AS (SELECT count(*) * {penalizer}::DOUBLE AS n FROM {rows})"]
    for k in range(steps):
        sums = ", ".join(f"sum({v}) AS s{m}, sum(event * {v}) AS q{m}" for m, v in parts.items())
        later = ", ".join(f"sum(s{m}) OVER (ORDER BY duration DESC) AS s{m}, q{m}" for m in parts)
        left = ", ".join(f"s{m} - i * q{m} / d AS p{m}" for m in parts)
        out += [
            f"cr{k} AS (SELECT c.*, exp(a * {x} + b * {y}) AS r FROM {rows} c, beta{k})",
            f"cl{k} AS (SELECT duration, sum(event)::BIGINT AS d, sum(event * {x}) AS ex, sum(event * {y}) AS ey, {sums} FROM cr{k} GROUP BY duration)",
            f"cs{k} AS (SELECT duration, d, ex, ey, {later} FROM cl{k})",
            f"ct{k} AS (SELECT d, ex, ey, i, {left} FROM cs{k}, unnest(range(d)) t(i))",
            f"cg{k} AS (SELECT sum(ex / d - p1 / p0) AS gx, sum(ey / d - p2 / p0) AS gy, sum(p11 / p0 - p1 * p1 / p0 / p0) AS xx, sum(p12 / p0 - p1 * p2 / p0 / p0) AS xy, sum(p22 / p0 - p2 * p2 / p0 / p0) AS yy FROM ct{k})",
            f"ch{k} AS (SELECT a, b, gx - n * a AS gx, gy - n * b AS gy, xx + n AS xx, xy, yy + n AS yy FROM cg{k}, many, beta{k})",
            f"beta{k + 1} AS (SELECT a + (gx * yy - gy * xy) / (xx * yy - xy * xy) AS a, b + (gy * xx - gx * xy) / (xx * yy - xy * xy) AS b FROM ch{k})",
        ]
    return tuple(out)

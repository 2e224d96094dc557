"""SQL that is put together: for line deduplication, vector codes and the Merkle manifest."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINE_DEDUP = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS nth FROM d),
    k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
    m AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 2),
    j AS (SELECT k.*, m.key IS NOT NULL AND k.doc_id IS DISTINCT FROM m.first AS gone FROM k LEFT JOIN m USING (key))
    SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM j GROUP BY r
"""


def lloyd(rounds: int = 2, parts: int = 16, entries: int = 64) -> str:
    """Codes by all distances, a round after the other."""
    steps = f"""
    WITH k AS (
        SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, * FROM (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
    w AS (SELECT greatest(1, (max(len(v)) + {parts - 1}) // {parts}) AS w FROM k),
    p AS (SELECT r, part, list_transform(range(part * w, part * w + w), lambda i: coalesce(v[i + 1], 0)) AS x FROM k, w, range({parts}) t(part)),
    b0 AS (SELECT part, r - 1 AS entry, x FROM p WHERE r <= {entries})"""
    for k in range(rounds + 1):
        steps += f""",
    a{k} AS (
        SELECT r, part, min_by(entry, (d, entry)) AS entry, min(d) AS d FROM (
            SELECT p.r, p.part, b.entry, CAST(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM p JOIN b{k} b USING (part))
        GROUP BY r, part)"""
        if k < rounds:
            steps += f""",
    m{k} AS (
        SELECT part, entry, list(m ORDER BY c) AS x FROM (
            SELECT part, entry, c, CAST((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
            FROM (SELECT p.part, a.entry, unnest(p.x) AS x, generate_subscripts(p.x, 1) AS c FROM p JOIN a{k} a USING (r, part)) GROUP BY part, entry, c)
        GROUP BY part, entry),
    b{k + 1} AS (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m USING (part, entry))"""
    return steps + f""",
    e AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
    FROM k JOIN e USING (r)
    """


def _leaf(text: str) -> str:
    part = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
    return "sha256(" + " || ".join(part.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _crc32(text: str) -> str:
    """Bit by bit, the low one first."""
    byte = "list_reduce(list_prepend(xor(a, x), range(8)), lambda b, i: CASE WHEN b % 2 = 1 THEN xor(b // 2, 3988292384::BIGINT) ELSE b // 2 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)), lambda a, x: {byte}), 4294967295::BIGINT)"


def merkle(levels: int = 4, fan: int = 16) -> str:
    """Trees of up to fan ** levels leaves and as many groups."""
    lower = f"translate(text, '{_UPPER}', '{_LOWER}')"
    steps = f"""
    WITH d AS (SELECT *, coalesce('=' || source, '') AS tree, {_leaf('text')} AS leaf, CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {_leaf(lower)} ELSE {_leaf('text')} END AS other FROM documents),
    q AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS n FROM d),
    s0 AS (SELECT tree, n, leaf AS h, count(*) OVER (PARTITION BY tree) AS c FROM q)"""
    for side, tree in (("s", "tree, "), ("o", "")):
        if side == "o":
            steps += """,
    sub AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS g FROM s_end),
    o0 AS (SELECT g AS n, subroot AS h, count(*) OVER () AS c FROM sub)"""
        for k in range(levels):
            steps += f""",
    {side}r{k} AS (SELECT {tree}n // {fan} AS n, string_agg(h, '' ORDER BY n) AS x, any_value((c + {fan - 1}) // {fan}) AS c FROM {side}{k} s WHERE c > 1 GROUP BY {tree}s.n // {fan}),
    {side}{k + 1} AS (SELECT {tree}n, sha256(x) AS h, c FROM {side}r{k})"""
        steps += f""",
    {side}_end AS ({" UNION ALL ".join(f"SELECT {tree}h FROM {side}{k} WHERE c = 1" for k in range(levels + 1))})"""
    runs = [f"{side}{k}" for side in "so" for k in range(levels)]
    columns = [f", {side}{k}.x AS {side}{k}x, {n} // {fan**k} % {fan} AS {side}{k}i" for side, n in (("s", "q.n"), ("o", "g")) for k in range(levels)]
    joins = [f" LEFT JOIN sr{k} s{k} ON s{k}.tree = q.tree AND s{k}.n = q.n // {fan ** (k + 1)} LEFT JOIN or{k} o{k} ON o{k}.n = g // {fan ** (k + 1)}" for k in range(levels)]
    steps += f""",
    f0 AS (SELECT q.doc_id, q.leaf, q.other AS f, g, subroot{"".join(columns)} FROM q JOIN sub ON sub.tree = q.tree{"".join(joins)})"""
    left, right = (lambda k: f"substr({k}x, 1, 64 * {k}i)"), (lambda k: f"substr({k}x, 64 * {k}i + 65)")
    for i, k in enumerate(runs):
        steps += f""",
    f{i + 1} AS (SELECT * EXCLUDE (f), CASE WHEN {k}x IS NULL THEN f ELSE sha256({left(k)} || f || {right(k)}) END AS f FROM f{i})"""
    proof = " || ".join(f"coalesce({left(k)} || {right(k)}, '')" for k in runs)
    return steps + f"""
    SELECT doc_id, leaf, subroot, e.h AS root, sha256({proof}) AS proof_sha256, f AS folded_root, f = e.h AS verified FROM f{len(runs)}, o_end e
    """

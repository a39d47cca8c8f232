"""DuckDB SQL of those operators that SQL can express."""

from __future__ import annotations

from sqlcurio.llm.spotsigs import ANCHORS
from sqlcurio.llm.urlrules import Rule
from sqlcurio.plans.duck import crc32_sql, long_digits, xxh64_sql

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def mixing_sql(weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, block: int = 16, shard_rows: int = 128, most_shards: int = 4096, seed: int = 17) -> str:
    """Targets, quotas by listing every quotient, and words taken by counting every picked block."""
    draw = lambda n, name: f"('0x' || substr(md5('{n}:' || {name}), 1, 15))::BIGINT"
    turns = "CASE " + " ".join(f"WHEN turn = {k} THEN {w}" for k, w in enumerate(weights)) + " END"
    return f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size FROM documents
), s AS MATERIALIZED (
  SELECT *, {turns}::DOUBLE AS weight FROM (
    SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS ord,
           (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} AS turn
    FROM d GROUP BY source)
), fill AS (
  -- rounds: a source whose part would pass its cap is closed at the cap, the others share the rest
  SELECT 0 AS round, ord, weight, {most}::DOUBLE * source_size AS cap, false AS closed,
         {share}::DOUBLE * sum(source_size) OVER () / sum(weight) OVER () AS level FROM s
  UNION ALL
  SELECT round + 1, ord, weight, cap, now,
         ({share}::DOUBLE * sum(cap) OVER () / {most} - sum(CASE WHEN now THEN cap ELSE 0 END) OVER ())
           / nullif(sum(CASE WHEN now THEN 0 ELSE weight END) OVER (), 0)
  FROM (SELECT *, closed OR cap <= weight * coalesce(level, 0) AS now FROM fill)
  WHERE round < (SELECT count(*) FROM s)
), t AS MATERIALIZED (
  SELECT s.ord, s.source, s.source_size, least(ceil(s.n / {shard_rows}.0), {most_shards})::BIGINT AS shards,
         CASE WHEN f.closed THEN f.cap ELSE f.weight * f.level END AS target
  FROM s JOIN fill f ON f.ord = s.ord AND f.round = (SELECT count(*) FROM s)
), seats AS (SELECT round(sum(target) / {block})::BIGINT AS n FROM t),
blocks AS MATERIALIZED (
  SELECT ord, count(*) AS blocks FROM (
    SELECT ord, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, ord, k) AS place
    FROM t, (SELECT unnest(range(0, (SELECT n FROM seats))) AS k) WHERE target > 0)
  WHERE place <= (SELECT n FROM seats) GROUP BY ord
), p AS MATERIALIZED (
  SELECT d.doc_id, d.size, t.ord, t.source_size, t.target, coalesce(b.blocks, 0) AS blocks,
         {draw(seed, "d.doc_id")} AS lot, {draw(seed + 1, "d.doc_id")} % t.shards AS shard
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN blocks b ON b.ord = t.ord
), q AS MATERIALIZED (SELECT ord, shard, sum(size)::BIGINT AS length, any_value(blocks) AS blocks FROM p GROUP BY ord, shard
), quotas AS MATERIALIZED (
  SELECT ord, shard, count(*) AS quota FROM (
    SELECT ord, shard, blocks, row_number() OVER (PARTITION BY ord ORDER BY length::DOUBLE / (2 * k + 1) DESC, shard, k) AS place
    FROM (SELECT ord, shard, length, blocks, unnest(range(0, blocks)) AS k FROM q WHERE length > 0))
  WHERE place <= blocks GROUP BY ord, shard
), cut AS MATERIALIZED (
  SELECT *, {draw(seed + 2, "ord || ':' || shard")} % m AS start, least(quota, (m * {most})::BIGINT) AS picks
  FROM (SELECT q.ord, q.shard, coalesce(u.quota, 0) AS quota, ceil(q.length / {block}.0)::BIGINT AS m FROM q LEFT JOIN quotas u USING (ord, shard) WHERE q.length > 0)
), picked AS MATERIALIZED (
  -- how often each block is picked: picks at even steps from the start
  SELECT ord, shard, k, ((k + 1 + start) * picks) // m - ((k + start) * picks) // m AS times
  FROM (SELECT ord, shard, start, picks, m, unnest(range(0, m)) AS k FROM cut)
), laid AS MATERIALIZED (
  SELECT *, sum(size) OVER (PARTITION BY ord, shard ORDER BY lot, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS last FROM p
), words AS (
  SELECT l.doc_id, sum(b.times * (least(l.last, (b.k + 1) * {block}) - greatest(l.last - l.size, b.k * {block})))::BIGINT AS taken
  FROM (SELECT doc_id, ord, shard, size, last, unnest(range((last - size) // {block}, (last - 1) // {block} + 1)) AS k FROM laid WHERE size > 0) l
  JOIN picked b ON b.ord = l.ord AND b.shard = l.shard AND b.k = l.k GROUP BY l.doc_id
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM laid LEFT JOIN words USING (doc_id)"""


def repeats_sql(least: int = 100) -> str:
    """Every string of ``least`` bytes looked up among all others; texts as hexadecimal digits, two to a byte."""
    return f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS raw FROM documents
), places AS (
  SELECT doc_id, raw, unnest(range(0, len(raw) // 2 - {least - 1})) AS pos FROM d WHERE len(raw) >= {2 * least}
), strings AS MATERIALIZED (SELECT doc_id, pos, md5_number(substr(raw, 2 * pos + 1, {2 * least})) AS name FROM places
), earlier AS MATERIALIZED (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY name ORDER BY doc_id, pos) AS n FROM strings) WHERE n > 1
), runs AS MATERIALIZED (
  -- strings that start within ``least`` of one another are one removed run
  SELECT doc_id, run, min(pos) AS a, max(pos) + {least} AS b FROM (
    SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (
      SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= {least} THEN 0 ELSE 1 END AS fresh FROM earlier))
  GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS g, a AS h FROM runs
  UNION ALL SELECT doc_id, max(b), NULL FROM runs GROUP BY doc_id
), left_over AS (
  SELECT d.doc_id, string_agg(substr(raw, 2 * g + 1, 2 * (coalesce(h, len(raw) // 2) - g)), '' ORDER BY g) AS kept
  FROM gaps JOIN d USING (doc_id) GROUP BY d.doc_id
), spans AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, (len(raw) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, raw))) AS kept_sha256
FROM d LEFT JOIN spans USING (doc_id) LEFT JOIN left_over USING (doc_id)"""


def simhash_sql(width: int = 4, most_bits: int = 4) -> str:
    """Fingerprints by counting each bit, links by comparing all pairs of distinct ones, components by reach."""
    bits = range(64)
    votes = ", ".join(f"sum(((h >> {b}) & 1)::BIGINT * times) AS b{b}" for b in bits)
    half = lambda low: " + ".join(f"CASE WHEN 2 * b{b} > n THEN {1 << (b - low)}::BIGINT ELSE 0 END" for b in range(low, low + 32))
    return f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}') AS w FROM documents
), shingled AS MATERIALIZED (
  SELECT row, s, count(*) AS times FROM (
    SELECT row, array_to_string(w[i:i + {width - 1}], ' ') AS s FROM (SELECT row, w, unnest(range(1, greatest(len(w) - {width - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0))
  GROUP BY row, s
), names AS MATERIALIZED (SELECT s, hex(encode(s)) AS x FROM (SELECT DISTINCT s FROM shingled)),
{xxh64_sql("names", "hashed")},
votes AS (SELECT row, sum(times) AS n, {votes} FROM shingled JOIN hashed USING (s) GROUP BY row),
prints AS MATERIALIZED (SELECT row, doc_id, coalesce(hi, 0) AS hi, coalesce(lo, 0) AS lo FROM d LEFT JOIN (SELECT row, {half(32)} AS hi, {half(0)} AS lo FROM votes) USING (row)),
nodes AS MATERIALIZED (SELECT hi, lo, min(doc_id) AS least, row_number() OVER () AS node FROM prints GROUP BY hi, lo),
links AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM nodes a, nodes b WHERE bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= {most_bits}),
reach AS (SELECT node, node AS other FROM nodes UNION SELECT node, b FROM reach JOIN links ON other = a),
roots AS (SELECT r.node, min(least) AS component_id FROM reach r JOIN nodes ON other = nodes.node GROUP BY r.node)
SELECT doc_id, lower(lpad(hex(hi), 8, '0') || lpad(hex(lo), 8, '0')) AS fingerprint, component_id FROM prints JOIN nodes USING (hi, lo) JOIN roots USING (node)"""


def sharding_sql(shards: int = 16, bits: int = 5) -> str:
    """All rows numbered in one order: cell on the curve, lot, doc_id. The curve's transform runs step by step."""
    most = (1 << bits) - 1
    level = lambda axis: f"""{axis}_levels AS (SELECT {axis}, least(floor((coalesce(sum(n) OVER (ORDER BY {axis} NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2) * {most + 1} / sum(n) OVER ()), {most})::BIGINT AS level
  FROM (SELECT {axis}, count(*)::DOUBLE AS n FROM documents GROUP BY {axis}))"""  # noqa: E731
    steps, before = [], "c"

    def step(*values: str) -> None:
        nonlocal before
        steps.append(f"c{len(steps)} AS (SELECT * REPLACE ({', '.join(values)}) FROM {before})")
        before = f"c{len(steps) - 1}"

    masks = [1 << b for b in range(bits - 1, 0, -1)]
    for q in masks:
        step(f"CASE WHEN x0 & {q} > 0 THEN xor(x0, {q - 1}) ELSE x0 END AS x0")
        for k in (1, 2):
            swapped = lambda own, q=q, k=k: f"CASE WHEN x{k} & {q} = 0 THEN xor({own}, xor(x0, x{k}) & {q - 1})"
            step(f"{swapped('x0')} ELSE xor(x0, {q - 1}) END AS x0", f"{swapped(f'x{k}')} ELSE x{k} END AS x{k}")
    step("xor(x1, x0) AS x1")
    step("xor(x2, x1) AS x2")
    flips = "0::BIGINT"
    for q in masks:
        flips = f"xor({flips}, CASE WHEN x2 & {q} > 0 THEN {q - 1}::BIGINT ELSE 0 END)"
    step(*[f"xor(x{k}, {flips}) AS x{k}" for k in range(3)])
    index = " + ".join(f"((x{k} >> {b}) & 1) * {1 << (3 * b + 2 - k)}" for b in range(bits) for k in range(3))
    return f"""
WITH sized AS MATERIALIZED (
  SELECT doc_id, source, lang, (len(digits) // 2 + 1)::BIGINT AS size, {crc32_sql("digits")} AS text_crc32,
         CASE WHEN doc_id IS NOT NULL THEN {long_digits("doc_id")} END AS x
  FROM (SELECT *, hex(encode(coalesce(text, ''))) AS digits FROM documents)
), ids AS (SELECT DISTINCT doc_id, x FROM sized WHERE doc_id IS NOT NULL), {xxh64_sql("ids", "hashed")},
{level("source")}, {level("lang")},
c AS (
  SELECT sized.doc_id, size, text_crc32, coalesce(hashed.h, 42::UBIGINT) >> 33 AS lot, s.level AS x0, l.level AS x1, least(greatest(floor(2 * (ln(size) / ln(2))) - 8, 0), {most})::BIGINT AS x2
  FROM sized LEFT JOIN hashed USING (doc_id) JOIN source_levels s ON sized.source IS NOT DISTINCT FROM s.source JOIN lang_levels l ON sized.lang IS NOT DISTINCT FROM l.lang
), {", ".join(steps)},
placed AS (
  SELECT *, row_number() OVER (ORDER BY curve_index, lot, doc_id NULLS FIRST, text_crc32, size) - 1 AS place, count(*) OVER () AS total
  FROM (SELECT doc_id, size, text_crc32, lot, ({index})::BIGINT AS curve_index FROM {before})
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place * {shards} // total)::INTEGER AS shard,
       (place - ((place * {shards} // total) * total + {shards - 1}) // {shards})::BIGINT AS slot, NULL::INTEGER AS grown_shard, curve_index
FROM placed"""


def url_rules_sql(rules: list[Rule]) -> str:
    fits = lambda r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"
    by_length = sorted(rules, key=lambda r: (-len(r.name), r.name))
    pick = lambda what, otherwise: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{what(r)}'" for r in by_length) + f" ELSE {otherwise} END"
    return f"""
WITH cut AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_UPPER.lower()}') AS host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path
  FROM cut
)
SELECT page_id, host, path, {pick(lambda r: r.name, "NULL")} AS rule, {pick(lambda r: r.verdict, "'allow'")} AS verdict
FROM parts"""


def negatives_sql() -> str:
    """Every anchor scored against every row, whole vectors only."""
    return """
WITH v AS MATERIALIZED (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
  SELECT a.id AS anchor_id, r.id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score FROM v a, v r WHERE a.id % 50 = 0 AND r.id <> a.id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM scored WHERE same) WHERE place <= 5
)
SELECT * FROM (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
WHERE rank <= 3"""


def audit_sql() -> str:
    """Documents of each combination of failures are counted, and every order is read off the combinations."""
    letters = "ABCDE"
    fails = lambda f: f"CASE {f} " + " ".join(f"WHEN '{c}' THEN {c.lower()}" for c in letters) + " END"
    gone = lambda upto: "(" + " OR ".join(f"({c.lower()} AND strpos({upto}, '{c}') > 0)" for c in letters) + ")"
    return f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
), first AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS MATERIALIZED (
  SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * len(regexp_extract_all(d.text, '[A-Z]')) > 2 * length(d.text) AS c,
         regexp_matches(d.text, '[#$%&*|]') AS d, first < d.doc_id AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM d JOIN first USING (text) LEFT JOIN l ON l.doc_id = d.doc_id GROUP BY ALL
), letters AS (SELECT unnest(split('A,B,C,D,E', ',')) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), steps AS (SELECT filter_order, step, filter_order[step] AS f, filter_order[:step - 1] AS before FROM orders, (SELECT unnest(range(1, 6))::INTEGER AS step)),
counted AS MATERIALIZED (
  SELECT part, filter_order, step, f, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails AND a::INT + b::INT + c::INT + d::INT + e::INT = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN fails AND NOT gone AND good THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fails AND NOT gone AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM (SELECT *, {fails("f")} AS fails, {gone("before")} AS gone FROM m, steps) GROUP BY part, filter_order, step, f
)
SELECT * EXCLUDE (f), sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM counted"""


def spotsigs_sql(least: float = 0.02, few: int = 16, long_words: int = 24) -> str:
    """Each text and its edit as a list of tokens; chains by the places of content words."""
    common = ", ".join(f"'{w}'" for w in ANCHORS)
    jaccard = lambda x, y: f"CASE WHEN {x} = {y} THEN 1.0 ELSE len(list_intersect({x}, {y}))::DOUBLE / (len({x}) + len({y}) - len(list_intersect({x}, {y}))) END"
    near = lambda y: f"CASE WHEN o.few AND {y}.few THEN {jaccard('list_sort(list_distinct(o.spots || o.rest))', f'list_sort(list_distinct({y}.spots || {y}.rest))')} ELSE {jaccard('o.spots', f'{y}.spots')} END"
    none = lambda x: f"CASE WHEN {x} >= {least} THEN {x} ELSE 0.0 END"
    return f"""
WITH o AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC) AS place FROM documents),
pairs AS MATERIALIZED (
  SELECT a.doc_id, a.place, a.text, b.place AS next, a.text[:length(a.text) - length(a.text) // 2] || b.text[:length(a.text) // 2] AS edited
  FROM o a JOIN o b ON b.place = a.place % (SELECT count(*) FROM o) + 1
), texts AS (SELECT place, false AS e, lower(text) AS t FROM pairs UNION ALL SELECT place, true, lower(edited) FROM pairs),
worded AS (SELECT place, e, t, regexp_extract_all(t, '[\\p{{L}}\\p{{M}}\\p{{N}}]+') AS w FROM texts),
tokened AS (SELECT place, e, CASE WHEN len(w) > 0 AND length(array_to_string(w, '')) <= {long_words} * len(w) THEN w ELSE regexp_extract_all(t, '[^\\x20\\x09-\\x0D]') END AS w FROM worded),
marked AS MATERIALIZED (
  SELECT place, e, w, list_filter(w, lambda x: x NOT IN ({common})) AS c, list_filter(range(1, len(w) + 1), lambda i: w[i] NOT IN ({common})) AS places FROM tokened
), chained AS (
  -- a chain stands behind a common word if its first word is not the one right behind the content word before it
  SELECT place, e, w, c, list_transform(range(1, len(c)), lambda k: {{'s': md5(c[k] || ' ' || c[k + 1])[:8], 'spot': places[k] <> coalesce(places[k - 1], 0) + 1}}) AS s FROM marked
), prints AS MATERIALIZED (
  SELECT place, e, list_sort(list_distinct(list_transform(list_filter(s, lambda x: x.spot), lambda x: x.s))) AS spots,
         CASE WHEN len(c) > 1 THEN list_sort(list_distinct(list_transform(list_filter(s, lambda x: NOT x.spot), lambda x: x.s)))
              WHEN len(w) = 0 THEN [] ELSE [md5(array_to_string(list_transform(w, lambda x: CASE WHEN x IN ({common}) THEN chr(1) ELSE ' ' || x END), ''))[:8]] END AS rest
  FROM chained
), parted AS (SELECT place, e, spots, list_filter(rest, lambda x: NOT list_contains(spots, x)) AS rest FROM prints),
named AS MATERIALIZED (SELECT *, len(spots) < {few} AS few, array_to_string(spots, '') || CASE WHEN len(spots) < {few} THEN ':' || array_to_string(rest, '') ELSE '' END AS print FROM parted)
SELECT p.doc_id, length(p.text)::BIGINT AS n_chars, sha256(p.edited) AS edited_sha256, o.print AS fingerprint, x.print AS edited_fingerprint,
       {none(near("x"))} AS near_edited, {none(near("y"))} AS near_next
FROM pairs p JOIN named o ON o.place = p.place AND NOT o.e JOIN named x ON x.place = p.place AND x.e JOIN named y ON y.place = p.next AND NOT y.e"""

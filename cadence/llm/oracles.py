"""DuckDB SQL for the operators that SQL can express, written from the contract rather than the Spark plan."""

from __future__ import annotations

_UNIT = "((('0x' || substr(md5({key} || '|{path}'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"


def _tree_sql(shards: list[tuple[str, str, int]]) -> str:
    """CASE expression of a tree of equal leaves given as (region, rack, shard)."""
    def pick(options: list[tuple[str, int, str]]) -> str:
        draws = ", ".join(f"-ln({_UNIT.format(key='k', path=path)}) / {float(w)}" for path, w, _ in options)
        cases = " ".join(f"WHEN {i + 1} THEN {then}" for i, (_, _, then) in enumerate(options))
        return f"(CASE list_position([{draws}], list_min([{draws}])) {cases} END)"

    regions = list(dict.fromkeys(r for r, _, _ in shards))
    top = []
    for r in regions:
        racks = list(dict.fromkeys(k for q, k, _ in shards if q == r))
        inner = []
        for k in racks:
            leaves = [(f"{r}/{k}/{s}", 1, str(s)) for q, j, s in shards if (q, j) == (r, k)]
            inner.append((f"{r}/{k}", len(leaves), pick(leaves)))
        top.append((r, sum(1 for q, _, _ in shards if q == r), pick(inner)))
    return pick(top)


_EIGHT = [(f"r{i // 4}", f"k{i // 2}", i) for i in range(8)]

OP4 = r"""
WITH d AS (
  SELECT doc_id, coalesce('a' || source, 'b') AS src,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY src) - 1) % 3 AS INT) + 1] AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total,
             sum(cap) OVER (ORDER BY cap / weight, src ROWS UNBOUNDED PRECEDING) - cap AS cap_before,
             sum(weight) OVER (ORDER BY cap / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM w),
g AS (SELECT *, cap <= (total - cap_before) * weight / weight_left AS is_full FROM f),
t AS (SELECT src, source_size,
             CASE WHEN is_full THEN cap
                  ELSE (total - sum(CASE WHEN is_full THEN cap ELSE 0.0::DOUBLE END) OVER ()) * weight
                       / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () END AS target FROM g),
p AS (SELECT d.*, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
             sum(size) OVER (PARTITION BY src ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
      FROM d JOIN t USING (src))
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
            + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM p
"""

OP7 = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)
"""

# crc32 (reflected polynomial 0xEDB88320) byte by byte over the UTF-8 bytes, by the usual 256-entry table
def _crc_entry(c: int) -> int:
    for _ in range(8):
        c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
    return c


_T = "[" + ", ".join(f"{_crc_entry(n)}::BIGINT" for n in range(256)) + "]"

OP1 = f"""
WITH d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, k, len(x) // 2 + 1 AS size,
             list_transform(range(1, len(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT) AS bytes FROM d),
c AS (SELECT doc_id, k, size,
             xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, v:
                 xor(a >> 8, {_T}[CAST(xor(a, v) & 255 AS INT) + 1])), 4294967295::BIGINT) AS text_crc32 FROM b),
t AS (SELECT doc_id, k, size, text_crc32, {_tree_sql(_EIGHT)} AS shard,
             {_tree_sql([*_EIGHT, ('r+8', 'k+8', 8)])} AS grown_shard FROM c)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(k), doc_id, size, text_crc32) - 1 AS slot,
       CAST(grown_shard AS INT) AS grown_shard
FROM t
"""

# every capture against every interval of its patterns, without the as-of window
OP2 = r"""
WITH p AS (
  SELECT page_id, url, lower(rtrim(regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '.')) AS host,
         list_filter(string_split(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda s: s <> '') AS seg,
         DATE '2024-01-01' + (('0x' || substr(md5(coalesce(CAST(page_id AS VARCHAR), 'null') || '|' || coalesce(url, '')), 1, 7))::INT % 366) AS day
  FROM pages),
l AS (SELECT *, CASE WHEN regexp_matches(host, '^[0-9]+([.][0-9]+){3}$') OR host LIKE '[%' THEN [host] ELSE string_split(host, '.') END AS lab FROM p),
k AS (
  SELECT page_id, url, day, host AS pattern FROM l WHERE host <> ''
  UNION SELECT page_id, url, day, array_to_string(lab[i:len(lab)], '.') FROM l, range(1, 20) r(i) WHERE host <> '' AND i <= greatest(len(lab) - 1, 1)
  UNION SELECT page_id, url, day, host || '/' || array_to_string(seg[1:i], '/') FROM (SELECT *, unnest(range(1, len(seg) + 1)) AS i FROM l) WHERE host <> ''),
s AS (SELECT DISTINCT pattern FROM k WHERE ('0x' || substr(md5('listed:' || pattern), 1, 7))::INT % 3 = 0),
e AS (
  SELECT CASE WHEN ('0x' || substr(md5('list:' || pattern), 1, 7))::INT % 2 = 0 THEN 'spam' ELSE 'adult' END AS list, pattern,
         DATE '2024-01-01' + (('0x' || substr(md5('day' || n || ':' || pattern), 1, 7))::INT % 366) AS day,
         CASE WHEN n = 1 THEN 'drop' ELSE 'add' END AS action
  FROM s, range(0, 3) r(n)),
d AS (SELECT list, pattern, day, max(action) AS action FROM e GROUP BY ALL),
v AS (SELECT list, pattern, action, day AS valid_from, lead(day) OVER (PARTITION BY list, pattern ORDER BY day) AS valid_to FROM d),
h AS (SELECT k.page_id, k.url, k.day, k.pattern, v.list FROM k JOIN v ON k.pattern = v.pattern AND v.action = 'add'
      AND k.day >= v.valid_from AND (v.valid_to IS NULL OR k.day < v.valid_to)),
g AS (SELECT page_id, url, day, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, max({'n': length(pattern), 'p': pattern}).p AS pattern FROM h GROUP BY ALL)
SELECT p.page_id, p.url, strftime(p.day, '%Y-%m-%d') AS fetch_day, g.pattern IS NOT NULL AS blocked, coalesce(lists, '') AS lists, g.pattern
FROM p LEFT JOIN g ON p.page_id = g.page_id AND p.url = g.url AND p.day = g.day
"""

ORACLES = {"op1_sharding": OP1, "op2_url_filter": OP2, "op4_mixing": OP4, "op7_exact_dedup": OP7}

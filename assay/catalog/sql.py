"""The corpora as SQL, for the other engine."""

EVENTS = """ev AS (
  SELECT event_id AS row_id,
    sha256(CAST(event_id - CASE WHEN event_id % 50 = 0 AND event_id > 0 THEN 1 ELSE 0 END AS VARCHAR)) AS sha256,
    CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN -1 ELSE 0 END AS label,
    CASE WHEN event_id % 97 <> 0 THEN CAST(ts AS DATE) END AS timestamp,
    CASE WHEN CAST(ts AS DATE) < DATE '2024-01-11' THEN 'train' WHEN event_type = 'error' AND event_id % 23 = 0 THEN 'challenge' ELSE 'test' END AS split,
    floor((0.6::DOUBLE * value / (value + 50.0::DOUBLE) + CASE WHEN event_type = 'error' THEN 0.5::DOUBLE * (1.0::DOUBLE - day(ts)::DOUBLE / 40.0::DOUBLE) ELSE 0.0::DOUBLE END) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS score
  FROM events)"""
LINES = """li AS (
  SELECT l_orderkey * 8 + l_linenumber AS row_id,
    sha256(CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR)) AS sha256,
    CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 ELSE -1 END AS label,
    CAST(l_shipdate AS DATE) AS timestamp,
    CASE WHEN CAST(l_shipdate AS DATE) < DATE '1999-01-01' THEN 'train' ELSE 'test' END AS split,
    floor((0.5::DOUBLE * l_quantity / 50.0::DOUBLE + CASE WHEN l_returnflag = 'R' THEN 0.05::DOUBLE * (2005.0::DOUBLE - year(l_shipdate)::DOUBLE) ELSE 0.0::DOUBLE END) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS score
  FROM lineitem)"""
MEMBERS = EVENTS + ", members AS (SELECT DISTINCT sha256 FROM ev WHERE split = 'train' AND row_id % 3 <> 0)"
#: Test rows without members, first row of a hash in each class.
EVAL = MEMBERS + """, ok AS (SELECT * FROM ev WHERE split = 'test' AND label >= 0 AND sha256 NOT IN (SELECT sha256 FROM members)),
  first AS (SELECT label, sha256, min(row_id) AS row_id FROM ok GROUP BY ALL), eval AS (SELECT ok.* FROM ok JOIN first USING (row_id, label, sha256))"""
#: Distinct scores with running counts, over rows (score, label).
STEPS = """, g AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM {rows} WHERE label >= 0 GROUP BY score),
  c AS (SELECT score, p, n, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS np, sum(n) OVER () AS nn FROM g)"""


def wilson(k: str, n: str, end: str) -> str:
    z2 = "(1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE)"
    p, m = f"({k}::DOUBLE / {n})", f"({n})::DOUBLE"
    half = f"1.959963984540054::DOUBLE * sqrt(greatest({p} * (1 - {p}) / {m} + {z2} / (4 * {m} * {m}), 0)) / (1 + {z2} / {m})"
    centre = f"({p} + {z2} / (2 * {m})) / (1 + {z2} / {m})"
    if end == "lo":
        return f"CASE WHEN {n} > 0 THEN CASE WHEN {k} = 0 THEN 0::DOUBLE ELSE greatest(0::DOUBLE, {centre} - {half}) END END"
    return f"CASE WHEN {n} > 0 THEN CASE WHEN {k} = {n} THEN 1::DOUBLE ELSE least(1::DOUBLE, {centre} + {half}) END END"

_M = "4294967296::UBIGINT"
_ROT = lambda x, r: f"((({x}) * {1 << r}::UBIGINT) % {_M} + ({x}) // {1 << (32 - r)}::UBIGINT)"
_MIX = lambda k: f"({_ROT(f'(({k}) * 3432918353::UBIGINT) % {_M}', 15)} * 461845907::UBIGINT % {_M})"


def murmur(tokens: str) -> str:
    """(token, h): MurmurHash3 x86 32-bit, signed, of each of the distinct tokens that a query (token) gives."""
    byte = lambda i: f"('0x' || substr(x, 2 * ({i}) + 1, 2))::UBIGINT"
    word = " || ".join(f"substr(x, 8 * i + {7 - 2 * k}, 2)" for k in range(4))
    tail = " + ".join(f"CASE WHEN n % 4 > {k} THEN {byte(f'n - n % 4 + {k}')} * {256**k}::UBIGINT ELSE 0::UBIGINT END" for k in range(3))
    last = f"h // {1 << 16}::UBIGINT"
    return f"""(SELECT token, CASE WHEN h >= 2147483648 THEN h::BIGINT - 4294967296 ELSE h::BIGINT END AS h FROM (SELECT token, xor(h, {last}) AS h FROM (SELECT token, xor(h, h // 8192::UBIGINT) * 3266489909::UBIGINT % {_M} AS h FROM (
  SELECT token, xor(h, {last}) * 2246822507::UBIGINT % {_M} AS h FROM (SELECT token, xor(CASE WHEN n % 4 > 0 THEN xor(h, {_MIX(tail)}) ELSE h END, n::UBIGINT) AS h FROM (
  SELECT token, x, n, list_reduce([0::UBIGINT] || list_transform(range(n // 4), lambda i: {_MIX(f"('0x' || {word})::UBIGINT")}), lambda h, k: ({_ROT('xor(h, k)', 13)} * 5::UBIGINT + 3864292196::UBIGINT) % {_M}) AS h
  FROM (SELECT token, hex(encode(token)) AS x, octet_length(encode(token)) AS n FROM (SELECT DISTINCT token FROM ({tokens})))))))))"""


def crc32(text: str) -> str:
    """The unsigned CRC-32 of a text."""
    half = "lambda c, _: xor(c // 2::UBIGINT, CASE WHEN c % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)"
    byte = f"('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::UBIGINT"
    return f"xor(list_reduce([4294967295::UBIGINT] || list_transform(range(octet_length(encode({text}))), lambda i: {byte}), lambda a, b: list_reduce([xor(a, b)] || list_transform(range(8), lambda i: 0::UBIGINT), {half})), 4294967295::UBIGINT)"

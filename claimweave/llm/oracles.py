"""DuckDB twins of the queries of this subpackage that SQL can express."""

from claimweave.llm.queries import MIX_EPOCHS, MIX_SEED

_UNIFORM = "CAST('0x' || substr(md5({}), 1, 13) AS BIGINT) / 4503599627370496.0"



def _crc_table() -> list[int]:
    """What a byte becomes in the common CRC-32, whose polynomial is 0xEDB88320, lowest bit first."""
    table = list(range(256))
    for _ in range(8):
        table = [v >> 1 ^ (0xEDB88320 if v & 1 else 0) for v in table]
    return table


_CRC_STEP = f"lambda c, b: xor(c // 256, ({_crc_table()}::BIGINT[])[xor(c % 256, b) + 1])"


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes."""
    read = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {read}), {_CRC_STEP}), 4294967295)"


def _encoded(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || {value}, '-')"


_LEAF = "sha256({})".format(" || ".join(map(_encoded, ("doc_id", "source", "lang", "n_chars", "text"))))

# A node: its group, level, number in the level, nodes of the level, digest. Parents are digests of runs of two until one node is left.
_CLIMB = """
  SELECT g, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM {0} WHERE n > 1 GROUP BY g, level, i // 2, n"""

_RATES = f"""
sources AS (
  SELECT source, sum(greatest(coalesce(length(text), 0), 1)) AS n_chars FROM documents GROUP BY source
), rates AS (
  SELECT source, {MIX_EPOCHS} * 1.0 / count(*) OVER () * sum(n_chars) OVER () / n_chars AS rate FROM sources
), parts AS (
  SELECT source, rate, CAST(greatest(ceil(rate / 8.0), 1) AS INT) AS parts FROM rates
), probability AS (
  SELECT source, parts, k, exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1)) AS p FROM parts, range(60) AS r(k)
), cumulated AS (
  SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS upto FROM probability
)"""

ORACLES = {
    "op5_poisson_mixing": f"""
WITH {_RATES}, drawn AS (
  SELECT d.doc_id, c.part, d.source, d.text, count(*) AS n
  FROM (SELECT d.*, unnest(range(1, p.parts + 1)) AS part FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source) d
  JOIN (SELECT source, part, upto FROM cumulated, range(1, 1 + parts) AS q(part)) c
    ON d.source IS NOT DISTINCT FROM c.source AND c.part = d.part
   AND c.upto <= {_UNIFORM.format(f"'{MIX_SEED}:' || d.doc_id || ':' || d.part")}
  GROUP BY ALL
), counts AS (
  SELECT doc_id, source, text, CAST(sum(n) AS INT) AS n_copies FROM drawn GROUP BY ALL
), copies AS (
  SELECT *, CAST(unnest(range(1, n_copies + 1)) AS INT) AS copy FROM counts
)
SELECT doc_id, source, n_copies, copy, round({_UNIFORM.format(f"'{MIX_SEED}:place:' || doc_id || ':' || copy")}, 12) AS position, text FROM copies
""",
    "op10_containment_search": r"""
WITH document_words AS (
  SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents
), item_words AS (
  SELECT item_id, hash(text) AS q, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark
), in_documents AS (
  SELECT DISTINCT doc_id, hash(text) AS t, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM document_words WHERE len(w) > 0)
), in_items AS (
  SELECT DISTINCT item_id, q, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)
), sizes AS (
  SELECT item_id, q, count(*) AS n_shingles FROM in_items GROUP BY item_id, q
), shared AS (
  SELECT d.doc_id, d.t, i.item_id, i.q, count(*) AS n FROM in_documents d JOIN in_items i USING (s) GROUP BY ALL
)
SELECT doc_id, item_id, best.n_shingles, best.n_shared, best.containment FROM (
  SELECT shared.doc_id, shared.item_id, max({'containment': round(n / n_shingles, 6), 'n_shingles': n_shingles, 'n_shared': n}) AS best
  FROM shared JOIN sizes ON shared.item_id IS NOT DISTINCT FROM sizes.item_id AND shared.q IS NOT DISTINCT FROM sizes.q
  WHERE n >= round(0.8 * n_shingles, 6) GROUP BY ALL)
""",
    "op11_merkle_manifest": f"""
WITH RECURSIVE plain AS MATERIALIZED (
  SELECT doc_id, n_chars, source || '' AS source, lang || '' AS lang, text || '' AS text FROM documents
), leaves AS MATERIALIZED (
  SELECT doc_id, lang, {_LEAF} AS leaf,
         CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_LEAF.replace("n_chars", "(n_chars + 1)")} END AS tampered
  FROM plain
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY coalesce('=' || lang, '')) AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), nodes(g, level, i, n, d) AS (
  SELECT g, 0, i, n, leaf FROM placed UNION ALL {_CLIMB.format("nodes")}
), subroots AS (
  SELECT g, d, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops(g, level, i, n, d) AS (
  SELECT CAST(0 AS BIGINT), 0, i, n, d FROM subroots UNION ALL {_CLIMB.format("tops")}
), trees AS (
  SELECT *, 0 AS tree FROM nodes UNION ALL SELECT *, 1 FROM tops
), beside AS (
  SELECT own.g, own.tree, own.level, own.i, coalesce(CASE WHEN own.i % 2 = 1 THEN other.d END, '') AS l, coalesce(CASE WHEN own.i % 2 = 0 THEN other.d END, '') AS r
  FROM trees own LEFT JOIN trees other ON other.g = own.g AND other.tree = own.tree AND other.level = own.level AND other.i = xor(own.i, 1)
  WHERE own.n > 1
), above AS (
  SELECT p.g, p.i, b.tree, b.level, b.l, b.r FROM placed p JOIN beside b ON b.g = p.g WHERE b.tree = 0 AND b.i = p.i // (1 << b.level)
  UNION ALL
  SELECT p.g, p.i, b.tree, b.level, b.l, b.r FROM placed p JOIN subroots s ON s.g = p.g JOIN beside b ON b.i = s.i // (1 << b.level) WHERE b.tree = 1
), paths AS (
  SELECT g, i, list(struct_pack(l := l, r := r) ORDER BY tree, level) AS path FROM above GROUP BY g, i
), way AS (
  SELECT p.doc_id, p.leaf, p.tampered, s.d AS subroot, path FROM placed p JOIN subroots s ON s.g = p.g LEFT JOIN paths ON paths.g = p.g AND paths.i = p.i
), folded AS (
  SELECT *, list_reduce(list_prepend(struct_pack(l := '', r := coalesce(tampered, leaf)), coalesce(path, [])), lambda a, b: struct_pack(l := '', r := sha256(b.l || a.r || b.r))).r AS folded_root,
         sha256(coalesce(array_to_string(list_transform(path, lambda x: x.l || x.r), ''), '')) AS proof_sha256
  FROM way
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded, (SELECT d AS root FROM tops WHERE n = 1)
""",
    "op12_jump_sharding": f"""
WITH RECURSIVE hashed AS MATERIALIZED (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, {_crc32("coalesce(text, '')")} AS text_crc32,
         row_number() OVER () AS own, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS UBIGINT) AS HUGEINT) AS seed
  FROM documents
), jumps(own, b, j, state) AS (
  SELECT own, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), seed FROM hashed
  UNION ALL
  SELECT own, j, CAST(floor((j + 1) * (CAST(2147483648 AS DOUBLE) / CAST(next // 8589934592 + 1 AS DOUBLE))) AS BIGINT), next
  FROM (SELECT own, j, (state * 2862933555777941757 + 1) % 18446744073709551616 AS next FROM jumps WHERE j < 25)
), placed AS (
  SELECT own, max(b) FILTER (WHERE b < 24) AS shard, max(b) AS grown_shard FROM jumps GROUP BY own
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM hashed JOIN placed USING (own)
""",
}

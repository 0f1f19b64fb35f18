"""The same results in DuckDB SQL, for the training-data queries that SQL can express."""

from __future__ import annotations

#: The CRC-32's remainders of the 256 bytes, as one list.
_REMAINDERS = """(SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b)
        FROM range(256) AS bytes(b))"""


def _crc32(text: str, remainders: str = "tab") -> str:
    """The CRC-32 of a text's UTF-8 bytes; ``remainders`` is the list of a column in reach."""
    octets = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, x: xor(c // 256, {remainders}[xor(c % 256, x) + 1])), 4294967295)"


def _jump(key: str, shards: int) -> str:
    """Jump consistent hashing; the state is a list of the seed, the shard and the next one."""
    seed = "((s[1] * 2862933555777941757 + 1) % 18446744073709551616)"
    ahead = f"CAST(floor(CAST(s[3] + 1 AS DOUBLE) * (CAST(2147483648 AS DOUBLE) / CAST({seed} // 8589934592 + 1 AS DOUBLE))) AS HUGEINT)"
    start = f"[CAST({key} AS HUGEINT) + CASE WHEN {key} < 0 THEN 18446744073709551616 ELSE 0 END, CAST(0 AS HUGEINT), CAST(0 AS HUGEINT)]"
    steps = f"list_transform(range({shards}), lambda i: [CAST(i AS HUGEINT)])"
    return f"CAST(list_reduce(list_prepend({start}, {steps}), lambda s, x: CASE WHEN s[3] < {shards} THEN [{seed}, s[3], {ahead}] ELSE s END)[2] AS INTEGER)"


def _leaf(text: str) -> str:
    parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


WARC = """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
    d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
    f AS (SELECT h, max(page_id) AS first FROM d WHERE n >= 1000 GROUP BY h)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
           CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN first <> page_id THEN first END AS refers_to
    FROM d LEFT JOIN f ON d.h = f.h AND n >= 1000"""

#: ``levels`` has each tree's nodes level by level; the trees of the sources and, as tree null of kind 1, the tree over them.
MERKLE = f"""
    WITH RECURSIVE rows AS (
        SELECT doc_id, source, {_leaf("text")} AS leaf,
               CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS torn
        FROM documents, (SELECT {_REMAINDERS} AS tab)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM rows),
    levels AS (
        SELECT source, 0 AS level, list(leaf ORDER BY rank) AS hs FROM ranked GROUP BY source
        UNION ALL
        SELECT source, level + 1, list_transform(range((len(hs) + 2) // 3), lambda i: sha256(array_to_string(hs[3 * i + 1 : 3 * i + 3], ''))) FROM levels WHERE len(hs) > 1),
    tops AS (SELECT source, hs[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM levels WHERE len(hs) = 1),
    over AS (
        SELECT 0 AS level, list(subroot ORDER BY place) AS hs FROM tops
        UNION ALL
        SELECT level + 1, list_transform(range((len(hs) + 2) // 3), lambda i: sha256(array_to_string(hs[3 * i + 1 : 3 * i + 3], ''))) FROM over WHERE len(hs) > 1),
    steps AS (
        SELECT 0 AS tier, level, r.source, r.rank, hs, rank // CAST(pow(3, level) AS BIGINT) AS spot FROM ranked r JOIN levels l ON r.source IS NOT DISTINCT FROM l.source AND len(hs) > 1
        UNION ALL
        SELECT 1, level, r.source, r.rank, hs, place // CAST(pow(3, level) AS BIGINT) FROM ranked r JOIN tops t ON r.source IS NOT DISTINCT FROM t.source, over o WHERE len(hs) > 1),
    paths AS (
        SELECT source, rank, list([array_to_string(hs[3 * (spot // 3) + 1 : spot], ''), array_to_string(hs[spot + 2 : 3 * (spot // 3) + 3], '')] ORDER BY tier, level) AS path
        FROM steps GROUP BY source, rank),
    found AS (
        SELECT doc_id, leaf, subroot, (SELECT hs[1] FROM over WHERE len(hs) = 1) AS root,
               sha256(coalesce(array_to_string(list_transform(path, lambda s: s[1] || s[2]), ''), '')) AS proof_sha256,
               list_reduce(list_prepend([torn, ''], coalesce(path, [])), lambda h, s: [sha256(s[1] || h[1] || s[2]), ''])[1] AS folded_root
        FROM ranked r JOIN tops t ON r.source IS NOT DISTINCT FROM t.source
        LEFT JOIN paths p ON r.source IS NOT DISTINCT FROM p.source AND r.rank = p.rank)
    SELECT *, folded_root = root AS verified FROM found"""

SHARDS = f"""
    SELECT doc_id, CAST(coalesce(strlen(text), 0) + 8 AS BIGINT) AS size, CAST({_crc32("coalesce(text, '')")} AS BIGINT) AS text_crc32, 'key' AS law, shard,
           CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS BIGINT) AS slot, grown AS grown_shard
    FROM (SELECT doc_id, text, coalesce({_jump("doc_id", 24)}, 0) AS shard, coalesce({_jump("doc_id", 25)}, 0) AS grown FROM documents), (SELECT {_REMAINDERS} AS tab)"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SEARCH = f"""
    WITH docs AS (SELECT row_number() OVER () AS d, doc_id, unnest({_TERMS}) AS term FROM documents),
    tf AS (SELECT d, doc_id, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY d) AS n FROM docs GROUP BY d, doc_id, term),
    total AS (SELECT count(DISTINCT d) AS documents, count(*) AS occurrences FROM docs),
    w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(documents) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, total GROUP BY term),
    asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
    scored AS (
        SELECT item_id, d, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + CAST(90 * n * documents AS BIGINT) // occurrences)))) AS BIGINT) AS score
        FROM asked JOIN tf USING (term) JOIN w USING (term), total GROUP BY item_id, d, doc_id)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10"""

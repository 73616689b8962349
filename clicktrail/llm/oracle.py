"""DuckDB SQL for the queries that SQL can express on whole tables."""

from clicktrail.llm.secrets import ACCESS, ALLOW, ASSIGN, ASSIGN_CHARS, CLASSES, HEX

_BLANK = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def _chat_escape(column: str) -> str:
    for plain, written in [("~", "~0"), ("[INST", "~1"), ("[/INST", "~2"), ("</s", "~3")]:
        column = f"replace({column}, '{plain}', '{written}')"
    return column


_MARKED = "(contains({0}, '[INST') OR contains({0}, '[/INST') OR contains({0}, '</s>'))"


def _matches(kind_no: int, kind: str, pattern: str, extra: str = "true") -> str:
    """Matches of a pattern with their start, added up from what lies between."""
    quoted = pattern.replace("'", "''")
    return f"""
        SELECT doc_id, {kind_no} AS kind_no, '{kind}' AS kind, hit,
               list_sum([length(x) for x in gaps[1:i]]) + coalesce(list_sum([length(x) for x in hits[1:i-1]]), 0) AS start
        FROM (SELECT *, unnest(hits) AS hit, unnest(range(1, len(hits) + 1)) AS i FROM (
          SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{quoted}', 0) AS hits,
                 string_split_regex(coalesce(text, ''), '{quoted}') AS gaps FROM documents))
        WHERE {extra}"""


def _entropy(kind_no: int, cls) -> str:
    allowed = " OR ".join(f"regexp_matches(hit, '{p}')" for p in ALLOW)
    hot = (f"[i for i in range(1, length(hit) - {cls.window} + 2) if "
           f"list_entropy(string_split(substring(hit, i, {cls.window}), '')) >= {cls.bits}]")
    return f"""
        SELECT doc_id, {kind_no} AS kind_no, '{cls.kind}' AS kind, start + hot[1] - 1 AS start,
               start + hot[-1] - 1 + {cls.window} AS stop
        FROM (SELECT *, {hot} AS hot FROM ({_matches(kind_no, cls.kind, f"{cls.chars}{{{cls.window},}}", f"NOT ({allowed})")}))
        WHERE len(hot) > 0"""


# checksum of a text of ASCII characters: xor each one in, then eight shifts
_CRC32 = ("xor(list_reduce(list_concat([4294967295::BIGINT], flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] "
          "for c in string_split({0}, '')])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 "
          "THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)")

_ASSIGNED = ASSIGN.replace("'", "''")

ORACLE: dict[str, str] = {
    "op3_secrets": f"""
        WITH base AS (
          SELECT doc_id, kind_no, kind, start, start + length(hit) AS stop FROM (
            {_matches(1, "assign", ASSIGN, f"length(regexp_extract(hit, '{_ASSIGNED}', 1)) >= {ASSIGN_CHARS}")}
            UNION ALL {_matches(2, "access", ACCESS)} UNION ALL {_matches(3, "hex", HEX)})),
        spans AS (
          SELECT * FROM base {' '.join(f"UNION ALL {_entropy(4 + i, c)}" for i, c in enumerate(CLASSES))}),
        joined AS (
          SELECT doc_id, count(*) FILTER (kind_no = 1) AS n_assign, count(*) FILTER (kind_no = 2) AS n_access,
                 count(*) FILTER (kind_no = 3) AS n_hex,
                 string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no) FILTER (kind_no <= 3) AS base,
                 string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no) AS every
          FROM spans GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
               coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
        FROM documents d LEFT JOIN joined j ON j.doc_id = d.doc_id""",
    "op5_near_vectors": """
        WITH RECURSIVE able AS (
          SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
            AND len([x for x in embedding if x <> 0]) > 0),
        pairs AS (
          SELECT a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
        reach AS (
          SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b),
        links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a),
        least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
        SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c, e.vec_id)) AS component_id,
               e.vec_id = least(e.vec_id, coalesce(c, e.vec_id)) AS kept
        FROM embeddings e LEFT JOIN links ON links.a = e.vec_id LEFT JOIN least ON least.a = e.vec_id""",
    "op6_chat_format": f"""
        WITH turns AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
          UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        written AS (
          SELECT *, CASE WHEN {_MARKED.format('text')} OR contains(role, '[/INST]') OR contains(role, '</s>')
            THEN '[INST~]' || {_chat_escape('role')} || '[/INST]' || {_chat_escape('text')} || '</s>'
            ELSE '[INST]' || role || '[/INST]' || text || '</s>' END AS formatted FROM turns),
        joined AS (
          SELECT conv_id, count(*) AS n_turns,
                 string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS every,
                 coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
                 sum(length(formatted))::BIGINT AS formatted_chars
          FROM written GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(every) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
               sha256(loss) AS loss_sha256, formatted_chars FROM joined""",
    "op4_line_dedup": f"""
        WITH cut AS (
          SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
        lines AS (
          SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM cut),
        keyed AS (
          SELECT *, translate(trim(line, {_BLANK}), {_UPPER}, {_LOWER}) AS key FROM lines),
        first AS (
          SELECT key, min(doc_id) AS doc_id FROM keyed WHERE length(key) >= 10 GROUP BY key),
        kept AS (
          SELECT k.doc_id, k.pos, k.line, f.doc_id IS NULL OR f.doc_id = k.doc_id AS keep
          FROM keyed k LEFT JOIN first f ON f.key = k.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT keep) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keep), '')) AS kept_sha256
        FROM kept GROUP BY doc_id""",
    "op11_prefix_trie": f"""
        WITH turns AS (
          SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, ''))
                 ORDER BY turn NULLS FIRST, coalesce(role, ''),
                          md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS own
          FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        drawn AS (
          SELECT *, ({_CRC32.format("conv_id::VARCHAR")} % 4)::INT AS h FROM turns),
        rebuilt AS (
          SELECT c.conv_id, coalesce(b.own[1:c.h], []) || c.own[c.h + 1:] AS seq
          FROM drawn c LEFT JOIN turns b ON b.conv_id = c.conv_id - c.conv_id % 20),
        prefixes AS (
          SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS depth FROM rebuilt),
        nodes AS (
          SELECT seq[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                 coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(seq) = depth), '') AS ends,
                 bool_and(len(seq) = depth) AS leaf
          FROM prefixes GROUP BY 1, 2),
        above AS (
          SELECT *, unnest(range(depth + 1)) AS up,
                 CASE WHEN depth > 0 THEN (n_convs - 1) * len(regexp_extract_all(node[depth].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS saved
          FROM nodes),
        sums AS (
          SELECT node[1:up] AS node, count(*) FILTER (up = depth - 1) AS n_children, count(*) FILTER (leaf) AS n_leaves,
                 sum(saved)::BIGINT AS saved_tokens
          FROM above GROUP BY 1)
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves, s.saved_tokens,
               sha256(n.ends) AS ends_sha256
        FROM nodes n JOIN sums s ON s.node = n.node LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.node[1:n.depth - 1] AND p.depth = n.depth - 1""",
    "op13_fill_in_middle": r"""
        WITH units AS (
          SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                 sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS drawn FROM documents),
        h AS (
          SELECT *, len(u) AS n, ('0x' || drawn[1:8])::BIGINT AS h1, ('0x' || drawn[9:16])::BIGINT AS h2,
                 ('0x' || drawn[17:24])::BIGINT AS h3, ('0x' || drawn[25:32])::BIGINT AS h4 FROM units),
        cut AS (
          SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
        parts AS (
          SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix
          FROM cut)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM parts""",
}

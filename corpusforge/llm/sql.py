"""SQL of the pN_ queries, where SQL can tell their rows."""

from __future__ import annotations

_SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_SPACE}]+"


def _name(c: str) -> str:
    return f"lower(regexp_replace({c}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g'))"


def _category(c: str) -> str:
    return f"regexp_replace({_name(c)}, '[{_SPACE}-]+', '_', 'g')"


def _tokens(c: str) -> str:
    return f"coalesce(len(regexp_extract_all({c}, '{_TOKEN}')), 0)"


# The compatibility forms that the test tables hold - full-width forms, no-break space and ellipsis.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\xa0"
_PLAIN = "".join(map(chr, range(0x21, 0x7F))) + " "


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _words(c: str) -> str:
    """Words as TESTDATA.md has them, for texts whose compatibility forms are among those above."""
    form = f"lower(nfc_normalize(translate(replace(coalesce({c}, ''), '…', '...'), {_quoted(_WIDE)}, {_quoted(_PLAIN)})))"
    return f"regexp_extract_all({form}, '[\\p{{L}}\\p{{N}}]+')"


def _grams(words: str, size: int) -> str:
    if size == 1:
        return f"list_distinct({words})"
    runs = f"list_transform(range(1, greatest(1, len({words}) - {size} + 1) + 1), lambda i: array_to_string({words}[i:i + {size - 1}], ' '))"
    return f"CASE WHEN len({words}) = 0 THEN [] ELSE list_distinct({runs}) END"


def _common(size: int, pair: str, kept: str) -> str:
    """``g``: distinct prompts' grams ``s`` by set number ``k``; ``p``: pairs ``a, b`` of numbers with ``shared`` grams, that ``kept`` keeps."""
    return f"""w AS (SELECT example_id, prompt, {_words("prompt")} AS w FROM (SELECT DISTINCT example_id, prompt FROM examples WHERE example_id IS NOT NULL)),
        r AS (SELECT example_id, list_sort({_grams("w", size)}) AS s FROM w), t AS (SELECT DISTINCT s FROM r WHERE len(s) > 0), g AS (SELECT row_number() OVER () AS k, s, len(s) AS n FROM t),
        x AS (SELECT k, n, unnest(s) AS x FROM g), p AS (SELECT a.k AS a, b.k AS b, any_value(a.n) AS an, any_value(b.n) AS bn, count(*) AS shared FROM x a JOIN x b ON a.x = b.x AND {pair} GROUP BY a.k, b.k HAVING {kept})"""


def _groups(size: int, p: int, q: int) -> str:
    return f"""WITH RECURSIVE {_common(size, "a.k < b.k", f"count(*) * {q} >= (any_value(a.n) + any_value(b.n) - count(*)) * {p}")},
        near AS (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p UNION SELECT k, k FROM g), reach AS (SELECT x, y FROM near UNION SELECT r.x, n.y FROM reach r JOIN near n ON r.y = n.x),
        root AS (SELECT x AS k, min(y) AS root FROM reach GROUP BY x), m AS (SELECT DISTINCT example_id, root FROM r JOIN g USING (s) JOIN root USING (k)),
        f AS (SELECT root, min(example_id) AS first_id FROM m GROUP BY root) SELECT DISTINCT first_id, example_id AS member_id FROM m JOIN f USING (root) WHERE example_id != first_id"""


def oracle_sql() -> dict[str, str]:
    train = f"""train AS (SELECT example_id, min({_category("category")}) AS category, coalesce(max(token_count), 0) AS tokens
        FROM examples WHERE {_name("split")} = 'train' GROUP BY example_id),
        have AS (SELECT category, sum(tokens) AS tokens, count(*) AS n FROM train GROUP BY category),
        want AS (SELECT m.config_id, {_category("m.category")} AS category, m.target_share * c.target_train_tokens AS tokens, c.min_category_examples AS n
        FROM category_mixture m JOIN pilot_subset_config c USING (config_id)),
        met AS (SELECT w.config_id, w.category, coalesce(h.tokens, 0) < w.tokens AS t, coalesce(h.n, 0) < w.n AS e FROM want w LEFT JOIN have h ON w.category = h.category)"""
    sizes = f"WITH sizes AS (SELECT doc_id, text, {_tokens("text")} AS n FROM documents)"
    return {
        "p1_found": f"""WITH c AS (SELECT id AS case_id, {_words("prompt")} AS w FROM phase0_v1), n AS (SELECT case_id, w, least(8, len(w))::BIGINT AS n FROM c WHERE len(w) > 0),
            cw AS (SELECT DISTINCT case_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT case_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM n)),
            r AS (SELECT 'examples' AS found_in, example_id AS record_id, prompt AS text FROM examples WHERE {_name("split")} = 'train' UNION ALL SELECT 'documents', doc_id::VARCHAR, text FROM documents),
            rw AS (SELECT found_in, record_id, {_words("text")} AS w FROM r), l AS (SELECT DISTINCT n FROM n),
            g AS (SELECT found_in, record_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT found_in, record_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM rw CROSS JOIN l WHERE len(w) >= n))
            SELECT DISTINCT case_id, found_in, record_id FROM g JOIN cw USING (n, g)""",
        "p2_found": f"""WITH {_common(1, "a.k <= b.k", "count(*) * 4 >= (any_value(a.n) + any_value(b.n) - count(*)) * 3")},
            side AS (SELECT DISTINCT example_id, CASE {_name("split")} WHEN 'train' THEN false WHEN 'validation' THEN true WHEN 'test' THEN true END AS h FROM examples),
            m AS (SELECT example_id, k, h FROM r JOIN g USING (s) JOIN side USING (example_id) WHERE h IS NOT NULL), both_ AS (SELECT a, b FROM p UNION SELECT b, a FROM p)
            SELECT DISTINCT least(e.example_id, t.example_id) AS example_id_a, greatest(e.example_id, t.example_id) AS example_id_b FROM both_ JOIN m e ON e.k = a AND e.h JOIN m t ON t.k = b AND NOT t.h""",
        "p2_by_source": f"""WITH {_common(1, "true", "count(*) * 4 >= any_value(a.n) * 3")},
            side AS (SELECT DISTINCT example_id, {_name("split")} AS split, generator_id FROM examples), m AS (SELECT example_id, k, split, generator_id FROM r JOIN g USING (s) JOIN side USING (example_id)),
            tr AS (SELECT DISTINCT k FROM m WHERE split = 'train'), hit AS (SELECT a AS k, max((shared * 4 >= (an + bn - shared) * 3)::INT) AS alike FROM p JOIN tr ON tr.k = b GROUP BY a)
            SELECT split, generator_id, count(DISTINCT example_id) AS contained, count(DISTINCT example_id) FILTER (alike = 1) AS overlapping FROM m JOIN hit USING (k) WHERE split IN ('validation', 'test') GROUP BY ALL""",
        "p3_found": _groups(1, 3, 4),
        "p3_shingles": _groups(5, 4, 5),
        "p4_checks": """SELECT 'records' AS what, count(DISTINCT example_id) AS n FROM examples
            UNION ALL SELECT unnest(['example_ids_in_several_splits', 'family_ids_in_several_splits', 'template_ids_in_several_splits', 'splits_off_target', 'records_without_split']), 0""",
        "p5_checks": f"""WITH {train} SELECT config_id, category, have_tokens AS available_tokens, have_n AS available_examples, t AS short_tokens, e AS short_examples, true AS floor_kept, true AS tokens_close
            FROM (SELECT w.config_id, w.category, coalesce(h.tokens, 0) AS have_tokens, coalesce(h.n, 0) AS have_n, coalesce(h.tokens, 0) < w.tokens AS t, coalesce(h.n, 0) < w.n AS e FROM want w LEFT JOIN have h ON w.category = h.category)""",
        "p6_checks": f"""{sizes} SELECT spec_id, count(DISTINCT doc_id) AS texts, sum(greatest(1, ceil(n / max_tokens)))::BIGINT AS parts, sum(n)::BIGINT AS tokens, 0 AS overfull, 0 AS cut_in_vain, true AS well_filled
            FROM sizes JOIN size_limits ON purpose = 'container' GROUP BY spec_id""",
        "p7_checks": f"""WITH have AS (SELECT {_name("source")} AS source, sum({_tokens("text")}) AS n FROM documents GROUP BY 1)
            SELECT m.mix_id, {_name("m.source")} AS source, coalesce(h.n, 0) AS available_tokens, coalesce(h.n, 0) * m.max_repeats AS usable_tokens,
            coalesce(h.n, 0) * m.max_repeats < m.target_share * m.total_tokens AS short, false AS over_repeated, true AS close FROM source_mix m LEFT JOIN have h ON {_name("m.source")} = h.source""",
        "p8_checks": f"""{sizes} SELECT spec_id, count(*) AS texts, sum(n)::BIGINT AS tokens, 0 AS too_long, 0 AS wrong_overlap, 0 AS wrong_text, 0 AS gaps, 0 AS open_ends
            FROM sizes JOIN size_limits ON purpose = 'piece' AND n > max_tokens GROUP BY spec_id""",
        "p4_found": f"""WITH RECURSIVE rec AS (SELECT DISTINCT {_name("family_id")} AS f, template_id AS t, {_name("split")} AS s FROM examples),
            pairs AS (SELECT DISTINCT f, t FROM rec WHERE f IS NOT NULL AND t IS NOT NULL),
            near AS (SELECT DISTINCT a.f AS x, b.f AS y FROM pairs a JOIN pairs b USING (t)),
            reach AS (SELECT x, y FROM near UNION SELECT r.x, n.y FROM reach r JOIN near n ON r.y = n.x),
            root AS (SELECT x AS f, min(y) AS root FROM reach GROUP BY x UNION SELECT DISTINCT f, f FROM rec WHERE f IS NOT NULL AND f NOT IN (SELECT f FROM pairs)),
            by_t AS (SELECT t, min(root) AS root FROM pairs JOIN root USING (f) GROUP BY t),
            placed AS (SELECT coalesce(root.root, by_t.root) AS root, rec.s FROM rec LEFT JOIN root ON rec.f = root.f LEFT JOIN by_t ON rec.t = by_t.t),
            apart AS (SELECT root FROM placed WHERE root IS NOT NULL GROUP BY root HAVING count(DISTINCT s) > 1)
            SELECT DISTINCT f AS family_id FROM root WHERE root IN (SELECT root FROM apart)""",
        "p5_found": f"WITH {train} SELECT config_id, category, 'tokens' AS reason FROM met WHERE t UNION ALL SELECT config_id, category, 'examples' FROM met WHERE e",
        "p6_found": f"{sizes} SELECT spec_id, doc_id FROM sizes JOIN size_limits ON purpose = 'container' AND n > max_tokens",
        "p7_found": f"""WITH have AS (SELECT {_name("source")} AS source, sum({_tokens("text")}) AS n FROM documents GROUP BY 1)
            SELECT m.mix_id, {_name("m.source")} AS source FROM source_mix m LEFT JOIN have h ON {_name("m.source")} = h.source
            WHERE coalesce(h.n, 0) * m.max_repeats < m.target_share * m.total_tokens""",
        "p8_found": rf"""{sizes}, big AS (SELECT spec_id, max_tokens, doc_id, text FROM sizes JOIN size_limits ON purpose = 'piece' AND n > max_tokens),
            parts AS (SELECT spec_id, max_tokens, doc_id, unnest(string_split_regex(regexp_replace(text, '([.!?])[{_SPACE}]', E'\\1\n', 'g'), '[\r\n]')) AS part FROM big)
            SELECT spec_id, doc_id, CASE WHEN max({_tokens("part")}) > any_value(max_tokens) THEN 'inside' ELSE 'boundary' END AS cut_kind FROM parts GROUP BY spec_id, doc_id""",
    }

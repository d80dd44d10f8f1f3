"""The queries of plans.queries as DuckDB SQL, written independently of the DataFrame plans."""

from __future__ import annotations

from loomtext.functions.parsing import FAMILY_WORDS
from loomtext.functions.text import DIACRITICS
from loomtext.plans import lexicons as X
from loomtext.plans.evidence import FEATURES

SP = r"[\s\p{Z}]+"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '{SP}'), lambda t: t <> '')"


def bare(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '{SP}', '', 'g')"


def grams(b: str, n: int) -> str:
    """Of a column without white space; an expression here would be evaluated for every element of the lambda."""
    return f"CASE WHEN length({b}) >= {n} THEN list_distinct(list_transform(range(1, length({b}) - {n} + 2), lambda i: substr({b}, i, {n}))) ELSE [] END"


def shares(r: str, c: str) -> str:
    """Columns precision and recall over the gram sets r1..r3 and c1..c3."""
    both = {n: f"len(list_intersect({r}{n}, {c}{n}))" for n in (1, 2, 3)}
    per = {side: " + ".join(f"CASE WHEN len({r}{n}) > 0 AND len({c}{n}) > 0 THEN {both[n]} / len({side}{n}) ELSE 0 END" for n in (1, 2, 3)) for side in (r, c)}
    return f"{per[c]} AS precision_, {per[r]} AS recall_"


CHRF = "CASE WHEN precision_ > 0 AND recall_ > 0 THEN round(2 * precision_ * recall_ / (precision_ + recall_) / 3, 4) ELSE 0 END"


def all_grams(x: str, name: str) -> str:
    return ", ".join(f"{grams(x, n)} AS {name}{n}" for n in (1, 2, 3))


TURNS = "turns AS (SELECT a.conv_id, a.turn, a.role, a.text AS ref, b.text AS cand FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
BLEU = "CASE WHEN len(rw) > 0 AND len(cw) > 0 THEN round(exp(least(0, 1 - len(rw) / len(cw))) * len(list_filter(cw, lambda t: list_contains(rw, t))) / len(cw), 4) ELSE 0 END"
METRICS = (
    f"{TURNS}, f AS MATERIALIZED (SELECT *, {bare('ref')} AS rb, {bare('cand')} AS cb FROM turns), "
    f"g AS MATERIALIZED (SELECT *, {all_grams('rb', 'r')}, {all_grams('cb', 'c')}, {words('ref')} AS rw, {words('cand')} AS cw FROM f), "
    f"h AS MATERIALIZED (SELECT conv_id, turn, role, ref, cand, {BLEU} AS bleu1, {shares('r', 'c')} FROM g), m AS MATERIALIZED (SELECT *, {CHRF} AS chrf FROM h)"
)


def gate_sql(glossary: dict[str, tuple[str, ...]], source: str = "turns") -> str:
    """CTEs gate0 (parts) and gated (with blocking and gate)."""
    src = f"len(list_filter(regexp_split_to_array(ref, '{SP}'), lambda t: length(t) > 2 AND NOT regexp_matches(t, '\\p{{Nd}}')))"
    cand = f"len(list_filter(regexp_split_to_array(cand, '{SP}'), lambda t: length(t) > 2))"
    mixed, loose = [], []
    for term, rs in glossary.items():
        low = list(dict.fromkeys(r.lower() for r in rs))
        used = [f"contains(lower(cand), '{r}')" for r in low]
        if len(low) > 1:
            mixed.append(" + ".join(f"CAST({u} AS INTEGER)" for u in used) + " > 1")
        loose.append(f"CASE WHEN ({' OR '.join(used)}) AND NOT (contains(lower(ref), '{term}') OR len(list_filter(regexp_split_to_array(lower(ref), '{SP}'), lambda t: length(t) >= 4 AND starts_with(t, '{term[:3]}'))) > 0) THEN '{term}' END")
    return f"""gate0 AS MATERIALIZED (SELECT *, {cand} / nullif({src}, 0) AS binding, len({words('cand')}) / nullif(len({words('ref')}), 0) AS coverage,
        NOT (length(cand) - length(translate(cand, '{DIACRITICS}', '')) > 5 AND length(cand) > 40) AS translated,
        NOT (({') OR ('.join(mixed)})) AS consistent, list_filter([{', '.join(loose)}], lambda x: x IS NOT NULL) AS loose FROM {source}),
        gated AS MATERIALIZED (SELECT *, list_filter([CASE WHEN NOT coalesce(binding <= 3.5, false) THEN 'SOURCE_BINDING' END, CASE WHEN NOT coalesce(coverage >= 0.4, false) THEN 'COVERAGE' END, CASE WHEN NOT translated THEN 'ABSTENTION' END,
            CASE WHEN NOT consistent THEN 'TERM_CONSISTENCY' END, CASE WHEN len(loose) > 0 THEN 'CITATION_GROUNDING' END], lambda x: x IS NOT NULL) AS blocking FROM gate0),
        verdicts AS MATERIALIZED (SELECT *, CASE WHEN len(blocking) = 0 THEN 'PASS' ELSE 'BLOCKED' END AS gate FROM gated)"""


def default_gate(source: str) -> str:
    from loomtext.functions.gates import GLOSSARY

    return gate_sql(GLOSSARY, source)


def word_grams(table: str, key: str) -> str:
    return f"SELECT {key}, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) AS gram FROM (SELECT {key}, {words('lower(text)')} AS w FROM {table}) WHERE len(w) >= 3"


def panel(passage: str) -> str:
    return f"""panel AS (SELECT {passage} AS passage, doc_id, CAST(n_chars AS DOUBLE) AS length,
    round(len(list_distinct(w)) / greatest(len(w), 1), 6) AS variety, CAST(quality AS DOUBLE) AS judge
    FROM (SELECT d.*, l.quality, {words('text')} AS w FROM documents d JOIN labels l USING (doc_id)))"""


GAMMAS = f"""{panel('source')}, metric AS (SELECT unnest(['length', 'variety']) AS metric),
    long AS (SELECT passage, doc_id, judge, metric, CASE metric WHEN 'length' THEN length ELSE variety END AS v FROM panel, metric),
    pair AS (SELECT a.passage, a.metric, sign((a.v - b.v) * (a.judge - b.judge)) AS s FROM long a JOIN long b ON a.passage = b.passage AND a.metric = b.metric AND a.doc_id < b.doc_id),
    counted AS (SELECT passage, metric, sum(s) AS s, count(*) FILTER (s <> 0) AS n FROM pair GROUP BY ALL),
    gammas AS (SELECT p.passage, m.metric, CAST(coalesce(n, 0) AS BIGINT) AS n_pairs, CASE WHEN n > 0 THEN s / n ELSE 0 END AS gamma
               FROM (SELECT DISTINCT passage FROM panel) p CROSS JOIN metric m LEFT JOIN counted c ON c.passage = p.passage AND c.metric = m.metric)"""


def hash_tree(rows: str, keys: str, n: str, h: str, levels: int = 3) -> str:
    """CTEs up to `tree` (keys, h): blocks of 1,024 hashes, hashed level by level; a hash that is alone above the rows stays. rows: a CTE with the keys, a number from 0 and a hash."""
    out = f"tree0 AS (SELECT {keys}, {n} AS n, {h} AS h FROM {rows})"
    for k in range(levels):
        joined = "sha256(string_agg(h, chr(1) ORDER BY n))"
        up = joined if k == 0 else f"CASE WHEN count(*) = 1 AND n // 1024 = 0 THEN any_value(h) ELSE {joined} END"
        out += f", tree{k + 1} AS (SELECT {keys}, n // 1024 AS n, {up} AS h FROM tree{k} GROUP BY {keys}, n // 1024)"
    return out + f", tree AS (SELECT {keys}, h FROM tree{levels})"


def case(pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in pairs) + f" ELSE {default} END"


def hits(hints) -> str:
    return " + ".join(f"CAST(contains(lower(text), '{h}') AS INTEGER)" for h in hints)


_SCORES = {k: hits(v) for k, v in X.TONGUES.items()}
_TOP = "greatest(" + ", ".join(_SCORES.values()) + ")"
TAGGED = "SELECT doc_id, CASE WHEN " + _TOP + " = 0 THEN 'english' " + " ".join(f"WHEN {s} = {_TOP} THEN '{k}'" for k, s in _SCORES.items()) + " END AS tongue FROM documents"
TERM_HIT = " OR ".join([f"starts_with(t, '{t}')" for t in X.TERMS if len(t) >= 4] + [f"(length(t) >= 4 AND starts_with('{t}', t))" for t in X.TERMS])
SCHOOL = "SELECT *, " + case([(" OR ".join(f"contains(source, '{p}')" for p in ps), k) for k, ps in X.FRAGMENTS.items()], "'Unclassified'") + " AS school FROM documents"
DISAGREE = f"""o AS MATERIALIZED (SELECT conv_id, turn, {bare('text')} AS tb FROM conversations WHERE role = 'assistant' AND length(text) >= 8),
    v AS MATERIALIZED (SELECT conv_id, turn, {all_grams('tb', 'g')} FROM o),
    p AS MATERIALIZED (SELECT a.conv_id, a.g1 AS a1, a.g2 AS a2, a.g3 AS a3, b.g1 AS b1, b.g2 AS b2, b.g3 AS b3 FROM v a JOIN v b ON a.conv_id = b.conv_id AND a.turn < b.turn),
    w AS MATERIALIZED (SELECT conv_id, {shares('a', 'b')} FROM p), s AS (SELECT conv_id, avg({CHRF}) AS agree FROM w GROUP BY 1),
    n AS (SELECT conv_id, count(*) FILTER (role = 'assistant' AND length(text) >= 8) AS n_valid FROM conversations GROUP BY 1),
    d AS (SELECT n.conv_id, n_valid, round(coalesce(agree, 1), 3) AS agreement, round(1 - coalesce(agree, 1), 3) AS disagreement FROM n LEFT JOIN s USING (conv_id))"""
DISAGREED = "SELECT *, CASE WHEN n_valid < 2 THEN 'insufficient-candidates' WHEN disagreement < 0.3 THEN 'convergent' WHEN disagreement < 0.55 THEN 'mixed' ELSE 'divergent-review' END AS verdict FROM d"
CROSS = f"""ct AS MATERIALIZED (SELECT item_id, other_id, left(b.text, 60) AS cand, left(d.text, 60) AS ref, {bare('left(b.text, 60)')} AS cb, {bare('left(d.text, 60)')} AS rb FROM benchmark b LEFT JOIN parallel ON source_id = item_id LEFT JOIN documents d ON d.doc_id = other_id),
    cg AS MATERIALIZED (SELECT *, {all_grams('rb', 'r')}, {all_grams('cb', 'c')} FROM ct), cs AS (SELECT item_id, other_id, ref, {shares('r', 'c')} FROM cg),
    cross_ AS (SELECT item_id, round(avg(CASE WHEN ref <> '' THEN {CHRF} END), 3) AS crosslingual, count(other_id) AS n_parallels FROM cs GROUP BY 1)"""
PARALLELS = """tok AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: length(t) >= 4)) AS t FROM benchmark),
    low AS (SELECT doc_id, lower(text) AS x FROM documents),
    hit AS (SELECT item_id, doc_id, count(*) AS overlap FROM low JOIN tok ON contains(x, t) GROUP BY 1, 2),
    parallel AS (SELECT item_id AS source_id, doc_id AS other_id, overlap, CAST(row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS INTEGER) AS rank FROM hit QUALIFY rank <= 3)"""
REPLY = """r AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
    sp AS (SELECT event_id, CASE WHEN k % 10 <> 0 THEN greatest(1, least(5, k % 9)) / 5 END AS fidelity, CASE WHEN k % 10 <> 0 THEN 'compound lost ' || k END AS full_judgment FROM r),
    parsed AS (SELECT event_id, CAST(fidelity AS DOUBLE) AS fidelity, left(full_judgment, 12) AS judgment, CASE """ + " ".join(f"WHEN contains(lower(coalesce(full_judgment, '')), '{w}') THEN '{f}'" for w, f in FAMILY_WORDS) + """ ELSE 'novel' END AS family FROM sp)"""
LINES = "SELECT doc_id AS file, list_filter(string_split(text, chr(10)), lambda x: x <> '' AND NOT starts_with(x, '#')) AS x FROM documents"
FINETUNE = f"""{TURNS}, {default_gate('turns')}, pairs AS (SELECT conv_id, turn, [{', '.join(f"'{r}'" for r in X.REGISTERS)}][turn % 4 + 1] AS register FROM verdicts WHERE gate = 'PASS' AND ref <> cand)"""
ENTRIES = """entries AS (SELECT 'events' AS ledger, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, event_type AS step, '{"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '","step":"' || event_type || '","event_id":' || event_id || '}' AS raw FROM events
    UNION ALL SELECT 'conversations', NULL, 'EXP-' || conv_id, '' FROM conversations WHERE conv_id % 9 <> 0)"""
_FEATURES = "[" + ", ".join(f"['{f}', '{note or ''}']" for f, note in FEATURES.items()) + "]"

SQL = {
    "chrf_pairs": f"WITH {METRICS} SELECT conv_id, turn, CAST(chrf AS DOUBLE) AS chrf FROM m",
    "bleu1_pairs": f"WITH {METRICS} SELECT conv_id, turn, CAST(bleu1 AS DOUBLE) AS bleu1 FROM m",
    "metrics_by_role": f"WITH {METRICS} SELECT role, count(*) AS n, round(avg(chrf), 4) AS avg_chrf, round(avg(bleu1), 4) AS avg_bleu1, round(avg((chrf + bleu1) / 2), 4) AS avg_combined FROM m GROUP BY role",
    "ngram_overlap_topk": f"""WITH b AS ({word_grams('benchmark', 'item_id')}), d AS ({word_grams('documents', 'doc_id')}), c AS (SELECT item_id, doc_id, count(*) AS n_shared FROM b JOIN d USING (gram) GROUP BY 1, 2)
        SELECT item_id, doc_id, n_shared, CAST(row_number() OVER (PARTITION BY item_id ORDER BY n_shared DESC, doc_id) AS INTEGER) AS rank FROM c QUALIFY rank <= 3""",
    "gate_checks": f"""WITH {TURNS}, {gate_sql(X.RENDERINGS)} SELECT conv_id, turn, round(binding, 2) AS binding, round(coverage, 2) AS coverage, translated, array_to_string(loose, ',') AS ungrounded, array_to_string(blocking, ',') AS blocking,
        gate, CASE WHEN gate = 'PASS' THEN 'accepted' ELSE 'review' END AS decision FROM verdicts""",
    "verify_pairs": f"""WITH {METRICS}, {default_gate('m')}, o AS (SELECT *, CASE WHEN turn % 2 = 0 THEN chrf >= 0.3 ELSE true END AS gold_ok FROM verdicts)
        SELECT conv_id, turn, gate, gold_ok, gate = 'PASS' AND gold_ok AS verified, left(sha256(left(sha256(ref), 16) || chr(1) || left(cand, 40)), 16) AS result_id FROM o""",
    "junk_filter": f"SELECT conv_id, turn, length(text) AS n, length(text) - length(translate(text, '{DIACRITICS}', '')) AS n_diacritics FROM conversations WHERE length(trim(text)) >= 8 AND length(text) - length(translate(text, '{DIACRITICS}', '')) <= 5",
    "lexicon_tag": TAGGED,
    "tag_counts": f"WITH t AS ({TAGGED}) SELECT l.tongue, count(t.doc_id) AS n FROM (SELECT unnest(['{"', '".join([*X.TONGUES, 'latin'])}']) AS tongue) l LEFT JOIN t USING (tongue) GROUP BY 1",
    "term_density": f"""WITH t AS (SELECT conv_id, turn, lower(text) AS x, regexp_extract_all(lower(text), '{X.TERM_LETTERS}') AS tok FROM conversations)
        SELECT conv_id, turn, len(list_filter(tok, lambda t: {TERM_HIT})) AS n_terms, len(tok) AS n_tokens, CASE WHEN len(tok) > 0 THEN round(n_terms / len(tok), 4) ELSE 0 END AS density,
        array_to_string(list_filter([{', '.join(f"CASE WHEN contains(x, '{t}') THEN '{t}' END" for t in X.TERMS)}], lambda v: v IS NOT NULL), ',') AS found FROM t""",
    "school_index": f"""WITH s AS ({SCHOOL}), t AS (SELECT *, CAST({case([(f"school = '{k}'", v) for k, v in X.TIERS.items()], "'2'")} AS INTEGER) AS tier, {case([(f"school = '{k}'", v) for k, v in X.PERIODS.items()], "'Epic'")} AS period FROM s)
        SELECT school, tier, period, count(*) AS n, count(DISTINCT source) AS n_sources, CAST(sum(n_chars) AS BIGINT) AS chars FROM t GROUP BY ALL""",
    "gamma_by_passage": f"WITH {GAMMAS} SELECT passage, metric, n_pairs, round(gamma, 6) AS gamma FROM gammas",
    "gamma_by_metric": f"""WITH {GAMMAS}, a AS (SELECT metric, count(*) AS n_passages, avg(gamma) AS g FROM gammas GROUP BY metric)
        SELECT metric, n_passages, round(g, 6) AS avg_gamma, row_number() OVER (ORDER BY g DESC, metric) = 1 AS is_best, (SELECT max(g) FROM a) > (SELECT g FROM a WHERE metric = 'length') AS claim FROM a""",
    "pairwise_win_rank": f"""WITH {panel('source')}, p AS (SELECT a.passage, a.doc_id, CASE WHEN b.variety < a.variety - 0.05 THEN 1.0 WHEN a.variety < b.variety - 0.05 THEN 0.0 ELSE 0.5 END AS pt
            FROM panel a JOIN panel b ON a.passage = b.passage AND a.doc_id <> b.doc_id),
        s AS (SELECT passage, doc_id, CAST(sum(pt) AS DOUBLE) AS points FROM p GROUP BY 1, 2), t AS (SELECT n.passage, n.doc_id, coalesce(points, 0) AS points FROM panel n LEFT JOIN s ON s.passage = n.passage AND s.doc_id = n.doc_id)
        SELECT passage, doc_id, points, round(points / coalesce(nullif(max(points) OVER (PARTITION BY passage), 0), 1), 3) AS norm FROM t""",
    "candidate_disagreement": f"WITH {DISAGREE} {DISAGREED}",
    "token_containment_parallels": f"WITH {PARALLELS} SELECT * FROM parallel",
    "triangulation": f"""WITH {PARALLELS}, t AS (SELECT source_id, rank, other_id || '|' || coalesce(lang, '') || '|' || coalesce(left(text, 60), '') AS x FROM parallel JOIN documents ON doc_id = other_id),
        l AS (SELECT source_id, string_agg(x, '/' ORDER BY rank) AS x, count(*) AS n FROM t GROUP BY 1)
        SELECT item_id, coalesce(n, 0) AS n_parallels, n IS NOT NULL AS available, left(sha256(x), 16) AS parallels FROM benchmark LEFT JOIN l ON source_id = item_id""",
    "crosslingual_agreement": f"WITH {PARALLELS}, {CROSS} SELECT item_id, crosslingual, n_parallels FROM cross_",
    "reference_attach": "SELECT doc_id, coalesce(max_by(left(b.text, 20), item_id), '') AS refs FROM documents d LEFT JOIN benchmark b ON contains(d.text, b.text) GROUP BY doc_id",
    "challenge_simple_rules": r"""SELECT item_id, 'ACCURACY_ADDITION' AS family, text || ', and this was not stated in the original text' AS bad FROM benchmark
        UNION ALL SELECT item_id, 'STYLE', trim(lower(left(text, 1)) || substr(text, 2)) FROM benchmark WHERE lower(left(text, 1)) <> left(text, 1)
        UNION ALL SELECT item_id, 'SCOPE_NEGATION', CASE WHEN regexp_matches(text, '(?i)\b(not|no|never|nor)\b') THEN trim(regexp_replace(text, '(?i)\b(not|no|never|nor)\b', '')) ELSE 'not ' || text END FROM benchmark""",
    "challenge_pass_rate": """WITH e AS (SELECT CASE WHEN event_type = 'error' THEN 'STYLE' ELSE event_type END AS family, value < 25 AS ok FROM events),
        r AS (SELECT family, count(*) AS total, count(*) FILTER (ok) AS passed FROM e GROUP BY 1 UNION ALL SELECT 'ALL', count(*), count(*) FILTER (ok) FROM e WHERE family <> 'STYLE')
        SELECT *, round(passed / total, 4) AS rate, round(passed / total, 4) >= 0.9 AS reached FROM r""",
    "per_group_cap": "SELECT doc_id, source, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 5 AND n_chars > 300",
    "capped_families": "WITH c AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) SELECT doc_id, lang FROM c WHERE rn <= 22 ORDER BY doc_id, ascii(lang) LIMIT 90",
    "running_best": """WITH d AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, round(avg(value), 4) AS score FROM events GROUP BY 1, 2),
        w AS (SELECT *, max(score) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM d) SELECT *, best_before IS NULL OR score > best_before AS kept FROM w""",
    "best_trial": "SELECT event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) = 1",
    "run_upsert": """SELECT user_id, event_type, event_id, value, CASE WHEN event_type = 'purchase' THEN 'VERIFIED' WHEN value > 50 THEN 'DERIVED' WHEN event_type = 'view' THEN 'OBSERVED' ELSE 'DECLARED' END AS kind
        FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
    "seeded_sample": "SELECT doc_id, source, sha256('42:' || doc_id) AS sample_key FROM documents ORDER BY sample_key LIMIT 100",
    "price_lookup": """WITH p AS (SELECT replace(p_name, ' ', '-') AS id, floor(p_retailprice) / 1e9 AS prompt, p_size / 1e7 AS completion, p_partkey AS ord FROM part),
        u AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'vendor/' ELSE '' END || replace(p_name, ' ', '-') || CASE WHEN p_partkey % 3 = 0 THEN '-v2' ELSE '' END AS model, p_size FROM part),
        m AS (SELECT model, avg(p_size) AS quality, string_split(model, '/')[-1] AS tail FROM u GROUP BY 1),
        f AS (SELECT id, arg_max(prompt, ord) AS prompt, arg_max(completion, ord) AS completion, min(ord) AS ord FROM p GROUP BY id),
        w AS (SELECT DISTINCT string_split(tail, '-')[1] AS p1, string_split(tail, '-')[2] AS p2 FROM m WHERE len(string_split(tail, '-')) > 1),
        l AS (SELECT p1, p2, min_by(f, ord) AS f FROM w JOIN f ON contains(id, p1) AND contains(id, p2) GROUP BY 1, 2),
        j AS (SELECT model, f.*, 1 AS match_level FROM m JOIN f ON model = id UNION ALL SELECT model, f.*, 2 FROM m JOIN f ON tail = id
              UNION ALL SELECT model, unnest(l.f), 3 FROM m JOIN l ON string_split(tail, '-')[1] = p1 AND string_split(tail, '-')[2] = p2),
        k AS (SELECT * FROM j WHERE match_level IS NOT NULL QUALIFY row_number() OVER (PARTITION BY model ORDER BY match_level, ord) = 1),
        c AS (SELECT m.model, k.id, k.match_level, round(prompt * 15000 + completion * 5000, 6) AS cost, round((prompt * 15000 + completion * 5000) * 1000, 3) AS cost_per_1000, m.quality FROM m LEFT JOIN k USING (model))
        SELECT model, id, match_level, cost, cost_per_1000, CASE WHEN quality <> 0 AND cost_per_1000 <> 0 THEN round(quality / greatest(cost_per_1000, 1e-9), 6) END AS quality_per_cost FROM c""",
    "schema_gate": """WITH v AS (SELECT CASE WHEN event_id % 77 = 7 THEN 'bad type k' WHEN event_id % 13 = 0 THEN 'missing k' WHEN event_id % 11 = 0 THEN 'invalid JSON' WHEN event_id % 7 = 0 THEN 'invalid JSON' ELSE 'valid' END AS violation FROM events)
        SELECT violation, count(*) AS n FROM v GROUP BY 1""",
    "annotation_checks": """SELECT doc_id, array_to_string(list_filter([CASE WHEN quality <> 1 AND doc_id % 5 = 0 THEN 'bad value preference' END, CASE WHEN toxic = 1 THEN 'missing no_major_error' END], lambda x: x IS NOT NULL), ';') AS violations FROM labels""",
    "content_address": "WITH h AS (SELECT *, sha256(left(text, 2000) || chr(1) || source) AS hash FROM documents) SELECT doc_id, hash, source || ':' || doc_id || ':' || left(hash, 10) AS passage_id, left(sha256('v1|' || left(text, 40) || '|' || lang), 16) AS result_id FROM h",
    "gold_hashes": f"""WITH r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, sha256(role || chr(1) || text) AS h FROM conversations), {hash_tree('r', 'conv_id', 'n', 'h')}
        SELECT conv_id, h AS gold_hash, sha256(h || chr(1) || 'code' || chr(1) || 'config') AS run_signature FROM tree""",
    "ledger_step_counts": f"WITH {ENTRIES} SELECT ledger, step, count(*) AS n FROM entries GROUP BY 1, 2",
    "ledger_tail": f"WITH {ENTRIES} SELECT ledger, ts, step FROM entries WHERE contains(lower(raw), 'purchase') ORDER BY coalesce(ts, '') DESC, raw DESC LIMIT 10",
    "experiment_summary": f"""WITH {METRICS}, {default_gate('m')}, e AS (SELECT *, CASE WHEN turn % 3 <> 0 THEN conv_id % 6 / 5 END AS semantic, length(cand) / 100 AS latency FROM verdicts)
        SELECT role, count(*) AS n, round(avg(chrf), 4) AS avg_chrf, round(avg(bleu1), 4) AS avg_bleu1, round(avg(semantic), 3) AS avg_semantic, round(avg(semantic) FILTER (semantic > 0), 3) AS avg_semantic_nonzero,
        round(avg(CASE WHEN gate = 'PASS' THEN 1.0::DOUBLE ELSE 0 END), 3) AS proof_pass_rate, round(sum(latency), 1) AS total_time FROM e GROUP BY role""",
    "finetune_pairs": f"""WITH {FINETUNE} SELECT conv_id, turn, register, {case([(f"register = '{k}'", v) for k, v in X.INSTRUCTIONS.items()], "''")} AS instruction, 'render' AS source FROM pairs""",
    "register_counts": f"WITH {FINETUNE} SELECT register, count(*) AS n FROM pairs GROUP BY 1",
    "evidence_objects": f"""WITH {METRICS}, {default_gate('m')}, e AS (SELECT conv_id, turn, left(sha256(ref), 16) AS source_sha, left(sha256(cand), 16) AS candidate_sha, gate, CASE WHEN gate = 'PASS' THEN 'accepted' ELSE 'review' END AS decision, printf('%.4f', CAST(chrf AS DOUBLE)) AS chrf_text FROM verdicts)
        SELECT *, sha256(source_sha || chr(1) || candidate_sha || chr(1) || gate || chr(1) || decision || chr(1) || chrf_text) AS artifact_hash FROM e""",
    "feature_vectors": f"""WITH {PARALLELS}, {CROSS}, {DISAGREE}, judged AS ({DISAGREED}), z AS (SELECT judged.*, crosslingual, nullif(n_parallels, 0) AS n_parallels, unnest({_FEATURES}) AS f FROM judged LEFT JOIN cross_ ON item_id = conv_id),
        y AS (SELECT *, f[1] AS feature, CASE f[1] WHEN 'D_ensemble' THEN disagreement WHEN 'C_crosslingual' THEN crosslingual END AS value FROM z)
        SELECT conv_id, feature, CAST(value AS DOUBLE) AS value, CASE WHEN value IS NULL THEN 'unavailable' ELSE 'available' END AS status, CASE WHEN value IS NULL THEN nullif(f[2], '') END AS note,
            CASE WHEN feature = 'D_ensemble' THEN verdict END AS verdict, CASE WHEN feature = 'C_crosslingual' THEN n_parallels END AS n_parallels FROM y""",
    "semantic_parse": f"WITH {REPLY} SELECT event_id, fidelity, judgment, family FROM parsed",
    "balanced_objects": """SELECT event_id, props AS "object" FROM events""",
    "proposals": f"WITH {REPLY} SELECT CASE WHEN family = 'novel' THEN 'novel' ELSE 'family' END AS kind, nullif(family, 'novel') AS family, left(judgment, CASE WHEN family = 'novel' THEN 120 ELSE 80 END) AS snippet, event_id FROM parsed WHERE fidelity < 0.7 AND judgment <> ''",
    "file_index": f"WITH l AS ({LINES}) SELECT file, len(x) AS lines, CAST(coalesce(list_sum(list_transform(x, lambda e: length(e))), 0) AS BIGINT) AS chars FROM l",
    "positional_zip": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS i FROM documents)
        SELECT a.doc_id AS file, a.i, length(trim(a.line)) AS n_source, length(trim(b.line)) AS n_gold FROM l a JOIN l b ON b.doc_id = a.doc_id + 1 AND a.i = b.i WHERE trim(a.line) <> '' AND trim(b.line) <> ''""",
    "path_references": r"""WITH t AS (SELECT page_id, regexp_extract_all('see data/' || regexp_replace(url, '^https?://', '') || ', and tools/x.py.', '((?:data|tools)/[\w./-]+)', 1) AS p FROM pages)
        SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(p, lambda x: regexp_replace(x, '[.,;:)/-]+$', '')))), '|') AS paths FROM t""",
    "manifest_check": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "decontamination_levels": f"SELECT n_nationkey, array_to_string(({list(X.LEVELS)})[1:n_nationkey % 5], ',') AS defended, array_to_string(({list(X.LEVELS)})[n_nationkey % 5 + 1:4], ',') AS open FROM nation",
    "registry_audit": "SELECT count(*) AS n, count(*) FILTER (value > 1) AS valid, count(*) FILTER (NOT value > 1) AS invalid, array_to_string(list_sort(list(DISTINCT left(sha256(CAST(event_id AS VARCHAR)), 12)) FILTER (NOT value > 1)), ',') AS missing FROM events",
    "registry_missing": "SELECT DISTINCT left(sha256(CAST(event_id AS VARCHAR)), 12) AS missing FROM events WHERE NOT value > 1",
}

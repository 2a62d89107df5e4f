"""Building blocks of the reference SQL (DuckDB dialect): chains of CTEs over the feedback views."""

from __future__ import annotations

from voxtally import fixed
from voxtally.sources.taxonomy import lexicon, load_rules
from workloads.views import quoted as q

BLANKS = "' ' || chr(9) || chr(10) || chr(13)"
TOKEN = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_\x{0900}-\x{097F}]*[\p{L}\p{N}_])?"


def strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def to_null(x: str) -> str:
    return f"nullif({strip(x)}, '')"


def norm(x: str) -> str:
    return f"CASE WHEN {strip(x)} <> '' AND lower({strip(x)}) <> 'nan' THEN {strip(x)} END"


def values(rows) -> str:
    cell = lambda v: q(v) if isinstance(v, str) or v is None else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


def query(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(c.strip() for c in ctes) + "\n" + select


# --- cleaning ---------------------------------------------------------------

RATING_OK = r"regexp_full_match({x}, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?')"


def clean_ctes(src: str = "raw") -> str:
    numeric = RATING_OK.format(x="trim(rating)")
    return f"""
c_num AS (
  SELECT *, {to_null('feedback_id')} AS id, {to_null('feedback_text')} AS txt, {to_null('date')} AS dt,
    CASE WHEN {numeric} THEN CAST(trim(rating) AS DOUBLE) END AS num FROM {src}),
c_val AS (
  SELECT *, CASE WHEN num BETWEEN 1 AND 5 THEN num END AS good,
    CASE WHEN rating IS NULL OR trim(rating) = '' THEN NULL WHEN num IS NULL THEN 'Rating ''' || rating || ''' is not numeric.'
         WHEN num NOT BETWEEN 1 AND 5 THEN 'Rating ''' || rating || ''' is outside the allowed range 1-5.' END AS e_rating,
    coalesce(TRY_CAST(dt AS DATE), CAST(try_strptime(dt, ['%m/%d/%Y', '%Y-%m-%d %H:%M:%S']) AS DATE)) AS day FROM c_num),
c_err AS (
  SELECT *, CASE WHEN id IS NULL THEN 'feedback_id is empty.' END AS e_id,
    CASE WHEN txt IS NULL THEN 'feedback_text is empty or whitespace-only.' END AS e_text,
    CASE WHEN dt IS NOT NULL AND day IS NULL THEN 'Date ''' || dt || ''' could not be parsed.' END AS e_date,
    id IS NOT NULL AND count(*) OVER (PARTITION BY id) > 1 AS dup_id,
    txt IS NOT NULL AND count(*) OVER (PARTITION BY lower(txt)) > 1 AS dup_text FROM c_val),
c_own AS (
  SELECT *, CASE WHEN coalesce(e_id, e_text, e_rating) IS NOT NULL THEN 'error' WHEN e_date IS NOT NULL THEN 'warning'
    ELSE 'valid' END AS own FROM c_err),
cleaned AS (
  SELECT *, CASE WHEN dup_id AND own <> 'error' THEN 'error' WHEN dup_text AND own = 'valid' THEN 'warning' ELSE own END AS row_status,
    concat_ws('; ', e_id, e_text, e_rating, e_date,
      CASE WHEN dup_text AND own = 'valid' THEN 'Duplicate feedback_text detected.' END,
      CASE WHEN dup_id AND own <> 'error' THEN 'Duplicate feedback_id detected.' END) AS validation_errors FROM c_own),
issues AS (
  SELECT _row_number AS row_number, id AS feedback_id, 'empty_feedback_id' AS issue_type, e_id AS message, 'error' AS severity FROM cleaned WHERE e_id IS NOT NULL
  UNION ALL SELECT _row_number, id, 'empty_feedback_text', e_text, 'error' FROM cleaned WHERE e_text IS NOT NULL
  UNION ALL SELECT _row_number, id, 'invalid_rating', e_rating, 'error' FROM cleaned WHERE e_rating IS NOT NULL
  UNION ALL SELECT _row_number, id, 'invalid_date', e_date, 'warning' FROM cleaned WHERE e_date IS NOT NULL
  UNION ALL SELECT _row_number, id, 'duplicate_feedback_id', 'Duplicate feedback_id ''' || id || ''' detected.', 'error' FROM cleaned WHERE dup_id
  UNION ALL SELECT _row_number, id, 'duplicate_feedback_text', 'Duplicate feedback_text detected.', 'warning' FROM cleaned WHERE dup_text)"""


CLEANED_SELECT = f"""SELECT _row_number, row_status, validation_errors, strftime(day, '%Y-%m-%d') AS date_normalized, id AS feedback_id,
  txt AS feedback_text, {to_null('source')} AS source, dt AS date, good AS rating, {to_null('user_type')} AS user_type,
  {to_null('region')} AS region, CAST(NULL AS VARCHAR) AS product_area, {to_null('language')} AS language FROM cleaned"""

# --- personal data ----------------------------------------------------------

# (type, priority, ambiguous, RE2 pattern with the span as group 1, span anchored at the match start or end)
PII = (
    ("UPI", 10, False, r"(?i)(?:(?:UPI\s*ID|VPA|payment\s+address|upi\s+id)\s*[:\-]?\s*)?([a-zA-Z0-9._-]+@(?:upi))\b", "end"),
    ("EMAIL", 20, False, r"\b([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})\b", "end"),
    ("CARD", 35, False, r"(?i)(?:card\s+(?:ending\s+)?|ending\s+)((?:\d{4}[\s-]?){3}\d{4})\b", "end"),
    ("AADHAAR", 40, False, r"(?i)(?:aadhaar|aadhar|uid|identity\s+number)\s*[:\-#]?\s*(\d{4}[\s-]?\d{4}[\s-]?\d{4})\b", "end"),
    ("AADHAAR", 41, True, r"\b(\d{4}[\s-]\d{4}[\s-]\d{4})\b(?:[^\d\s-]|[\s-][^\d]|[\s-]?$)", "start"),
    ("ACCOUNT", 50, False, r"(?i)(?:account|a/c|bank\s+account|account\s+number)\s*(?:number|no\.?|#)?\s*[:\-]?\s*(\d{8,18})\b", "end"),
    ("TRANSACTION_ID", 60, False, r"(?i)(?:transaction|txn|reference|ref|payment\s+id)\s*[:\-#]?\s*([A-Z0-9-]{6,})\b", "end"),
    ("TRANSACTION_ID", 61, False, r"(?i)\b(TXN[A-Z0-9-]{6,})\b", "end"),
    ("TRANSACTION_ID", 62, False, r"(?i)\b(REF-\d{4}-\d{4,})\b", "end"),
    ("CARD", 71, True, r"\b((?:\d{4}[\s-]?){3}\d{4})\b", "end"),
    ("PAN", 80, False, r"(?i)(?:PAN|permanent\s+account\s+number)\s*[:\-#]?\s*([A-Z]{5}\d{4}[A-Z])\b", "end"),
    ("PAN", 81, True, r"\b([A-Z]{5}\d{4}[A-Z])\b", "end"),
)
# RE2 has no look-around: take whole digit runs (with a +91 in front) and test them afterwards.
PHONE = r"((?:[0-9]*\+91[\s-]?)?[0-9]+)"


def pii_ctes(src: str, column: str) -> str:
    def located(entity: str, priority: int, ambiguous: bool, pattern: str, anchor: str) -> str:
        p = q(pattern)
        begin = "mend - length(span)" if anchor == "end" else "mstart"
        return f"""SELECT _row_number, {q(entity)} AS entity_type, {priority} AS priority, {ambiguous} AS ambiguous, span, {begin} AS start
  FROM (SELECT _row_number, g[i] AS span, gap_len + tok_len AS mstart, gap_len + tok_len + length(m[i]) AS mend FROM (
    SELECT _row_number, m, g, i, list_sum(list_transform(gaps[1:i], lambda x: length(x))) AS gap_len,
      coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS tok_len
    FROM (SELECT _row_number, m, g, gaps, unnest(generate_series(1, len(m))) AS i FROM (
      SELECT _row_number, regexp_extract_all(raw_text, {p}) AS m, regexp_extract_all(raw_text, {p}, 1) AS g,
        string_split_regex(raw_text, {p}) AS gaps FROM p_text) WHERE len(m) > 0)))"""

    parts = [located(*row) for row in PII]
    phone = f"""SELECT _row_number, 'PHONE' AS entity_type, 30 AS priority, false AS ambiguous,
    CASE WHEN whole THEN span ELSE run END AS span, CASE WHEN whole THEN start ELSE start + length(span) - length(run) END AS start
  FROM (SELECT *, regexp_extract(span, '[0-9]+$') AS run, regexp_full_match(span, '\\+91[\\s-]?[6-9][0-9]{{9}}') AS whole
    FROM ({located('PHONE', 30, False, PHONE, 'end')})) WHERE whole OR regexp_full_match(run, '0?[6-9][0-9]{{9}}')"""
    union = "\n  UNION ALL\n  ".join([*parts, phone])
    return f"""
p_text AS (SELECT _row_number, {column} AS raw_text FROM {src}
  WHERE {column} IS NOT NULL AND {strip(column)} <> '' AND lower({strip(column)}) <> 'nan'),
p_cand AS (SELECT _row_number, entity_type, priority, ambiguous, CAST(start AS BIGINT) AS start, CAST(start + length(span) AS BIGINT) AS stop FROM (
  {union}) WHERE length(span) > 0),
p_rank AS (SELECT *, row_number() OVER (PARTITION BY _row_number ORDER BY priority, start, stop DESC) AS k FROM p_cand),
p_sel(_row_number, k, kept) AS (
  SELECT _row_number, k, [{{'s': start, 'e': stop, 't': entity_type, 'a': ambiguous}}] FROM p_rank WHERE k = 1
  UNION ALL
  SELECT r._row_number, r.k, CASE WHEN len(list_filter(p.kept, lambda x: r.start < x.e AND x.s < r.stop)) > 0 THEN p.kept
    ELSE list_append(p.kept, {{'s': r.start, 'e': r.stop, 't': r.entity_type, 'a': r.ambiguous}}) END
  FROM p_sel p JOIN p_rank r ON r._row_number = p._row_number AND r.k = p.k + 1),
p_span AS (SELECT _row_number, sp.s AS start, sp.e AS stop, sp.t AS entity_type, sp.a AS ambiguous FROM (
  SELECT _row_number, unnest(arg_max(kept, k)) AS sp FROM p_sel GROUP BY _row_number)),
p_piece AS (SELECT s.*, raw_text, coalesce(lag(stop) OVER (PARTITION BY s._row_number ORDER BY start), 0) AS before
  FROM p_span s JOIN p_text USING (_row_number)),
p_mask AS (SELECT _row_number,
  string_agg(substr(raw_text, before + 1, start - before) || '[' || entity_type || '_REDACTED]', '' ORDER BY start)
    || substr(any_value(raw_text), max(stop) + 1) AS masked,
  array_to_string(list_sort(list_distinct(list(entity_type))), '|') AS types,
  bool_or(ambiguous) OR count(DISTINCT entity_type) > 1 AS review,
  string_agg(entity_type || ':' || start || '-' || stop, '|' ORDER BY start) AS spans
  FROM p_piece GROUP BY _row_number)"""


def pii_masked_cte(src: str, column: str, name: str = "pm", keep: str = "s.*") -> str:
    missing = f"({column} IS NULL OR {strip(column)} = '' OR lower({strip(column)}) = 'nan')"
    return f"""
{name} AS (SELECT {keep}, CASE WHEN {missing} THEN '' ELSE coalesce(masked, {column}) END AS masked_text,
  masked IS NOT NULL AS pii_detected, coalesce(types, '') AS pii_entity_types, coalesce(review, false) AS pii_review_required,
  coalesce(spans, '') AS spans, {missing} AS missing FROM {src} s LEFT JOIN p_mask USING (_row_number))"""


# --- sentiment, themes, intent ----------------------------------------------


def _rule_tables(rules) -> str:
    stop = set(lexicon()["theme_stopwords"])
    head, terms, subs = [], [], []
    for i, r in enumerate(rules):
        head.append((i, r["theme"], max(2.0, 0.5 * (len(r["phrases"]) + len(r["keywords"]))), r["product_area"],
                     r["default_severity"], r["default_intent"], " ".join([*r["phrases"], *r["keywords"]])))
        for kind, field in ((0, "phrases"), (1, "keywords")):
            terms += [(i, kind, n, t) for n, t in enumerate(r[field]) if t not in stop]
        subs += [(i, n, s["name"], t) for n, s in enumerate(r["subthemes"]) for t in s["terms"]]
    words = lexicon()
    levels = [(n, label, t) for n, label in enumerate(("critical", "high", "medium", "low")) for t in words["severity"][label]]
    tones = [(tone, n, t) for tone in ("positive", "negative") for n, t in enumerate(words["sentiment"][tone])]
    return f"""
rule(rule_ord, theme, scale, area, dsev, dint, doc) AS ({values(head)}),
term(rule_ord, kind, pos, term) AS ({values(terms)}),
sub(rule_ord, pos, name, term) AS ({values(subs)}),
level(lvl, label, term) AS ({values(levels)}),
tone(tone, pos, term) AS ({values(tones)}),
points(label, score) AS ({values([(k, float(v)) for k, v in fixed.SEVERITY_SCORES.items()])})"""


def _said(terms) -> str:
    words = [t for t in terms if any(c.isalnum() for c in t)]
    plain = [t for t in terms if t not in words]
    test = "regexp_matches(low, " + q("(^|[^a-zA-Z0-9_])(" + "|".join(w.replace("?", r"\?") for w in words) + ")($|[^a-zA-Z0-9_])") + ")"
    return "(" + " OR ".join([test, *[f"contains(low, {q(t)})" for t in plain]]) + ")"


def _contains_any(terms) -> str:
    return "(" + " OR ".join(f"contains(low, {q(t)})" for t in terms) + ")"


def intent_case(default: str) -> str:
    w = lexicon()["intent"]
    return f"""CASE WHEN NOT {_contains_any(w['negation'])} AND {_said(w['praise'])} THEN 'praise'
      WHEN {_said(w['request'])} THEN 'request' WHEN {_said(w['question'])} THEN 'question'
      WHEN {_said(w['bug_report'])} THEN 'bug_report' ELSE {default} END"""


def keyword_ctes(src: str, column: str = "masked_text", preset: str = "fintech") -> str:
    """Up to a_rank (ranked themes per row), a_tone (sentiment) and a_sev."""
    return _rule_tables(load_rules(preset)) + f""",
a_text AS (SELECT *, {norm(column)} AS txt, lower({norm(column)}) AS low FROM {src}),
a_hit AS (SELECT a._row_number, t.rule_ord, t.kind, t.term, min(t.pos) AS pos FROM a_text a JOIN term t ON contains(a.low, t.term) GROUP BY ALL),
a_terms AS (SELECT _row_number, rule_ord, string_agg(term, '|' ORDER BY o) AS terms FROM (
  SELECT _row_number, rule_ord, term, min(kind * 1000 + pos) AS o FROM a_hit GROUP BY ALL) GROUP BY ALL),
a_sev AS (SELECT _row_number, arg_min(label, lvl) AS label FROM a_text a JOIN level l ON contains(a.low, l.term) GROUP BY ALL),
a_sub AS (SELECT _row_number, rule_ord, arg_min(name, pos) AS name FROM a_text a JOIN sub s ON contains(a.low, s.term) GROUP BY ALL),
a_score AS (SELECT _row_number, rule_ord, CAST(sum(CASE WHEN kind = 0 THEN 2 ELSE 1 END) AS DOUBLE) AS raw FROM a_hit GROUP BY ALL),
a_rank AS (SELECT s._row_number, s.rule_ord, r.theme, s.raw, least(1.0, s.raw / CAST(r.scale AS DOUBLE)) AS conf, r.area,
    coalesce(v.label, r.dsev) AS severity, coalesce(b.name, 'general') AS subtheme, t.terms,
    row_number() OVER (PARTITION BY s._row_number ORDER BY least(1.0, s.raw / CAST(r.scale AS DOUBLE)) DESC, p.score DESC, s.raw DESC, s.rule_ord) AS k
  FROM a_score s JOIN rule r USING (rule_ord) LEFT JOIN a_sev v USING (_row_number)
  LEFT JOIN a_sub b ON b._row_number = s._row_number AND b.rule_ord = s.rule_ord
  JOIN a_terms t ON t._row_number = s._row_number AND t.rule_ord = s.rule_ord JOIN points p ON p.label = coalesce(v.label, r.dsev)),
a_tone AS (SELECT a._row_number,
    string_agg(CASE WHEN tone = 'positive' THEN term END, '|' ORDER BY pos) AS good_terms,
    string_agg(CASE WHEN tone = 'negative' THEN term END, '|' ORDER BY pos) AS bad_terms,
    least(1.0, count(CASE WHEN tone = 'positive' THEN 1 END) / CAST(3 AS DOUBLE)) AS good,
    least(1.0, count(CASE WHEN tone = 'negative' THEN 1 END) / CAST(3 AS DOUBLE)) AS bad
  FROM a_text a LEFT JOIN tone t ON contains(a.low, t.term) GROUP BY ALL),
a_feel AS (SELECT _row_number, good, bad, good_terms, bad_terms,
    CASE WHEN txt IS NULL THEN 'unknown' WHEN good > 0 AND bad > 0 THEN 'mixed' WHEN bad > 0 THEN 'negative' WHEN good > 0 THEN 'positive' ELSE 'neutral' END AS label,
    CASE WHEN good > 0 AND bad > 0 THEN (good + bad) / 2 ELSE greatest(good, bad) END AS score
  FROM a_tone JOIN a_text USING (_row_number)),
a_kw AS (SELECT a._row_number, coalesce(r.theme, 'unknown') AS theme, coalesce(r.subtheme, 'unknown') AS subtheme,
    coalesce(r.conf, 0.0) AS conf, coalesce(r.terms, '') AS terms, coalesce(r.area, 'unknown') AS area,
    coalesce(r.severity, 'unknown') AS severity, CASE WHEN a.txt IS NULL THEN 'unknown' ELSE 'keyword_rule' END AS method,
    CASE WHEN a.txt IS NULL THEN {q(fixed.MSG_THEME_MISSING)} WHEN r.theme IS NULL THEN {q(fixed.MSG_NO_THEME_EVIDENCE)} END AS warning,
    r.theme IS NULL OR r.conf < 0.35 AS review
  FROM a_text a LEFT JOIN a_rank r ON r._row_number = a._row_number AND r.k = 1),
a_second AS (SELECT _row_number, theme, subtheme, conf, severity, terms, k FROM a_rank WHERE k > 1 AND conf >= 0.25),
a_names AS (SELECT _row_number, string_agg(theme, ', ' ORDER BY k) AS names FROM a_second GROUP BY ALL)"""


def tfidf_ctes(src: str, text: str) -> str:
    """f_w: normalised weight per (_row_number, term); f_vocab: term, n, df, idf.  ``text`` is already normalised."""
    return f"""
f_tok AS (SELECT _row_number, regexp_extract_all(lower({text}), {q(TOKEN)}) AS w FROM {src} WHERE {text} IS NOT NULL),
f_term AS (SELECT _row_number, unnest(w) AS term FROM f_tok
  UNION ALL SELECT _row_number, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) FROM f_tok),
f_tf AS (SELECT _row_number, term, count(*) AS tf FROM f_term GROUP BY ALL),
f_vocab AS (SELECT term, sum(tf) AS n, count(*) AS df,
    ln((1 + (SELECT count(*) FROM f_tok)) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf
  FROM f_tf GROUP BY term ORDER BY n DESC, term LIMIT {fixed.TFIDF_VOCABULARY}),
f_raw AS (SELECT _row_number, term, tf * idf AS x FROM f_tf JOIN f_vocab USING (term)),
f_w AS (SELECT _row_number, term, x / sqrt(sum(x * x) OVER (PARTITION BY _row_number)) AS weight FROM f_raw)"""


def fallback_ctes() -> str:
    """f_best: the most similar theme per row of a_text, where similar enough."""
    return f"""
g_tok AS (SELECT rule_ord, regexp_extract_all(lower(doc), {q(TOKEN)}) AS w FROM rule),
g_term AS (SELECT rule_ord, unnest(w) AS term FROM g_tok
  UNION ALL SELECT rule_ord, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) FROM g_tok),
g_raw AS (SELECT rule_ord, term, count(*) * any_value(idf) AS x FROM g_term JOIN f_vocab USING (term) GROUP BY ALL),
g_w AS (SELECT rule_ord, term, x / sqrt(sum(x * x) OVER (PARTITION BY rule_ord)) AS weight FROM g_raw),
f_sim AS (SELECT w._row_number, g.rule_ord, round(sum(w.weight * g.weight), 12) AS sim FROM f_w w JOIN g_w g USING (term) GROUP BY ALL),
f_top AS (SELECT *, row_number() OVER (PARTITION BY _row_number ORDER BY sim DESC, rule_ord) AS k FROM f_sim),
f_best AS (SELECT t._row_number, r.theme, t.sim, least(0.55, t.sim) AS conf, coalesce(b.name, 'general') AS subtheme, r.area,
    coalesce(v.label, r.dsev) AS severity
  FROM f_top t JOIN rule r USING (rule_ord) JOIN a_kw k ON k._row_number = t._row_number JOIN a_text x ON x._row_number = t._row_number
  LEFT JOIN a_sev v ON v._row_number = t._row_number LEFT JOIN a_sub b ON b._row_number = t._row_number AND b.rule_ord = t.rule_ord
  WHERE t.k = 1 AND t.sim >= 0.12 AND x.txt IS NOT NULL AND (k.theme = 'unknown' OR k.conf < 0.35))"""


def analysis_ctes(src: str, preset: str = "fintech", fallback: bool = False, pii: bool = True) -> str:
    """``an``: one row per record of ``src`` (needs _row_number, feedback_id, masked_text[, pii_review_required])."""
    merged = "SELECT * FROM a_kw"
    extra = ""
    if fallback:
        extra = ",\n" + tfidf_ctes("a_text", "txt").strip() + ",\n" + fallback_ctes().strip()
        merged = f"""SELECT k._row_number, coalesce(b.theme, k.theme) AS theme, coalesce(b.subtheme, k.subtheme) AS subtheme,
    coalesce(b.conf, k.conf) AS conf, CASE WHEN b.theme IS NULL THEN k.terms ELSE 'tfidf_similarity' END AS terms,
    coalesce(b.area, k.area) AS area, coalesce(b.severity, k.severity) AS severity,
    CASE WHEN b.theme IS NULL THEN k.method ELSE 'tfidf_fallback' END AS method,
    CASE WHEN b.theme IS NULL THEN k.warning ELSE {q(fixed.MSG_FALLBACK)} END AS warning, k.review OR b.theme IS NOT NULL AS review
  FROM a_kw k LEFT JOIN f_best b USING (_row_number)"""
    flag = "coalesce(a.pii_review_required, false)" if pii else "false"
    return keyword_ctes(src, preset=preset) + extra + f""",
a_all AS ({merged}),
a_conf AS (SELECT m.*, f.label AS sentiment, f.score AS sentiment_score,
    round_even(least(1.0, greatest(0.0, m.conf * 0.75 + f.score * 0.25)), 3) AS confidence FROM a_all m JOIN a_feel f USING (_row_number)),
an AS (SELECT a._row_number, a.feedback_id, c.sentiment, c.sentiment_score, c.theme AS primary_theme, c.subtheme AS primary_subtheme,
    c.conf AS primary_confidence, coalesce(n.names, '') AS secondary_themes, c.area AS product_area, c.severity, p.score AS severity_score,
    CASE WHEN a.txt IS NULL OR c.theme = 'unknown' THEN 'unknown' ELSE {intent_case('r.dint')} END AS intent,
    CASE WHEN c.terms = '' THEN '' ELSE 'Detected ' || replace(c.theme, '_', ' ') || ' related to: '
      || array_to_string(string_split(c.terms, '|')[1:3], ', ') END AS customer_problem,
    c.confidence, c.terms AS matched_terms,
    c.review OR {flag} OR c.theme = 'unknown' OR c.confidence < 0.4 OR c.sentiment = 'unknown' AS requires_human_review,
    c.method AS analysis_method,
    concat_ws('|', CASE WHEN a.txt IS NULL THEN {q(fixed.MSG_MASKED_MISSING)} END,
      CASE WHEN a.txt IS NOT NULL AND c.theme = 'unknown' THEN {q(fixed.MSG_NO_THEME)} END,
      CASE WHEN a.txt IS NOT NULL THEN c.warning END, CASE WHEN {flag} THEN {q(fixed.MSG_PII_REVIEW)} END) AS analysis_warnings
  FROM a_text a JOIN a_conf c USING (_row_number) LEFT JOIN a_names n USING (_row_number)
  LEFT JOIN rule r ON r.theme = c.theme JOIN points p ON p.label = c.severity)"""


# --- mentions, insights -----------------------------------------------------


def mention_ctes(fb: str = "masked") -> str:
    """``mt``: one row per theme and record with the feedback facts; ``tot``: number of records.  Ids are unique here."""
    return f"""
m_all AS (SELECT _row_number, feedback_id, primary_theme AS theme_name, true AS is_primary, severity, primary_confidence AS conf,
    sentiment, confidence AS record_confidence FROM an
  UNION ALL SELECT an._row_number, an.feedback_id, s.theme, false, s.severity, s.conf, an.sentiment, an.confidence
  FROM an JOIN a_second s USING (_row_number)),
m_one AS (SELECT * FROM m_all WHERE theme_name NOT IN ('unknown', 'other')
  QUALIFY row_number() OVER (PARTITION BY theme_name, feedback_id ORDER BY is_primary DESC) = 1),
facts AS (SELECT feedback_id AS fid, {to_null('source')} AS source, {to_null('user_type')} AS user_type, rating, {to_null('date')} AS date,
    coalesce(TRY_CAST({to_null('date')} AS DATE), CAST(try_strptime({to_null('date')}, ['%m/%d/%Y', '%Y-%m-%d %H:%M:%S']) AS DATE)) AS day,
    CASE WHEN length({norm('masked_text')}) <= 220 THEN {norm('masked_text')} END AS quote FROM {fb}),
mt AS (SELECT m.*, f.source, f.user_type, f.rating, f.date, f.day, f.quote FROM m_one m JOIN facts f ON f.fid = m.feedback_id),
tot AS (SELECT count(DISTINCT {to_null('feedback_id')}) AS total FROM {fb})"""


def quote_ctes() -> str:
    """``picks``: the greedy choice per theme, by walking the ranked candidates one by one."""
    return """
q_row AS (SELECT theme_name, feedback_id, quote, coalesce(source, 'unknown') AS pool, source, date, rating,
    row_number() OVER (PARTITION BY theme_name ORDER BY record_confidence DESC, feedback_id) AS k FROM mt WHERE quote IS NOT NULL),
q_step(theme_name, n, pools, quotes, feedback_id, quote, source, date, rating) AS (
  SELECT theme_name, 1, [pool], [quote], feedback_id, quote, source, date, rating FROM q_row WHERE k = 1
  UNION ALL
  SELECT theme_name, n + 1, list_append(pools, b.pool), list_append(quotes, b.quote), b.feedback_id, b.quote, b.source, b.date, b.rating FROM (
    SELECT s.theme_name, s.n, s.pools, s.quotes, arg_min({'feedback_id': r.feedback_id, 'quote': r.quote, 'pool': r.pool,
      'source': r.source, 'date': r.date, 'rating': r.rating}, r.k) AS b
    FROM q_step s JOIN q_row r ON r.theme_name = s.theme_name AND NOT list_contains(s.pools, r.pool) AND NOT list_contains(s.quotes, r.quote)
    WHERE s.n < 3 GROUP BY s.theme_name, s.n, s.pools, s.quotes)),
picks AS (SELECT theme_name, CAST(n - 1 AS INT) AS position, feedback_id, quote, source, date, rating FROM q_step)"""


def insight_ctes() -> str:
    """``ins``: one row per theme with the scalar measures; needs mt, tot and picks."""
    return f"""
i_core AS (SELECT theme_name, count(*) FILTER (is_primary) AS primary_count, count(*) FILTER (NOT is_primary) AS secondary_count,
    count(*) AS mention_count, round_even(count(*) / CAST(any_value(total) AS DOUBLE) * 100, 2) AS feedback_percentage,
    round_even(avg(rating), 3) AS average_rating, round_even(avg(conf), 3) AS confidence,
    count(DISTINCT CASE WHEN source <> 'unknown' THEN source END) AS known_sources,
    count(*) FILTER (sentiment = 'negative') AS negative, count(*) FILTER (severity = 'critical') AS n_critical,
    count(*) FILTER (severity = 'high') AS n_high, count(*) FILTER (severity = 'medium') AS n_medium, count(*) FILTER (severity = 'low') AS n_low,
    strftime(min(day), '%Y-%m-%d') AS start_date, strftime(max(day), '%Y-%m-%d') AS end_date, any_value(total) AS total
  FROM mt, tot GROUP BY theme_name),
i_quotes AS (SELECT theme_name, count(*) AS quotes FROM picks GROUP BY ALL),
i_num AS (SELECT c.*, coalesce(quotes, 0) AS quotes,
    coalesce((n_low * 1 + n_medium * 2 + n_high * 4 + n_critical * 5) / CAST(nullif(n_low + n_medium + n_high + n_critical, 0) AS DOUBLE), 0) AS avg_severity
  FROM i_core c LEFT JOIN i_quotes USING (theme_name)),
i_warn AS (SELECT *, concat_ws('|', CASE WHEN mention_count <= 2 THEN {q(fixed.MSG_FEW_RECORDS)} END, CASE WHEN quotes = 0 THEN {q(fixed.MSG_NO_QUOTES)} END) AS warnings FROM i_num),
ins AS (SELECT *, CASE WHEN mention_count <= 2 OR warnings <> '' OR confidence < 0.35 THEN 'weak'
      WHEN mention_count >= 5 AND confidence >= 0.5 AND quotes >= 2 AND (known_sources >= 2 OR known_sources = 0) THEN 'strong'
      WHEN mention_count >= 3 THEN 'moderate' ELSE 'weak' END AS evidence_strength,
    round_even(mention_count / CAST(total AS DOUBLE), 4) AS frequency_score, round_even(avg_severity / 5, 4) AS severity_score,
    round_even(confidence, 4) AS confidence_score,
    round_even(mention_count / CAST(total AS DOUBLE) * (avg_severity / 5) * confidence, 4) AS priority_score,
    CASE WHEN n_critical > 0 OR n_high > 0 OR average_rating <= 2.5 THEN 'High' WHEN n_medium > 0 THEN 'Medium' ELSE 'Low' END AS impact,
    CASE WHEN length(warnings) = 0 THEN 0 ELSE len(string_split(warnings, '|')) END AS warnings_count
  FROM i_warn)"""

"""SQL oracles (DuckDB dialect) for the registered queries.

Each oracle is independent SQL over the driver's raw tables: the fixture
views are re-derived as CTEs, and the Python-``re`` patterns are rewritten
for RE2, which has no look-around, so word boundaries become consuming
classes. That rewrite is only valid for existence tests and for patterns
whose boundaries sit at the ends or around one ``.*`` — the forms the fixed
lists use.
"""

from __future__ import annotations

from acctsig.functions import patterns as P

W_BODY = r"\p{L}\p{N}_"
WS_BODY = (r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
           r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
W = f"[{W_BODY}]"
NW = f"[^{W_BODY}]"
WS = f"[{WS_BODY}]"
NWS = f"[^{WS_BODY}]"
_GAP = r"(?:[^\p{L}\p{N}_\n]|[^\p{L}\p{N}_\n].*[^\p{L}\p{N}_\n])"


def re2(pattern: str, ignore_case: bool = False) -> str:
    """Python ``re`` search pattern -> RE2 search pattern (existence only)."""
    p = pattern.replace(r"\b.*\b", "\x00")
    if p.startswith(r"\b"):
        p = "\x01" + p[2:]
    if p.endswith(r"\b"):
        p = p[:-2] + "\x02"
    if r"\b" in p:
        raise ValueError(f"unsupported boundary position in {pattern!r}")
    out, i, in_class = [], 0, False
    while i < len(p):
        c = p[i]
        if c == "\\" and i + 1 < len(p):
            e = p[i + 1]
            if e == "u":
                out.append(r"\x{" + p[i + 2:i + 6] + "}")
                i += 6
                continue
            if e == "U":
                out.append(r"\x{" + p[i + 2:i + 10].lstrip("0") + "}")
                i += 10
                continue
            if in_class:
                out.append({"w": W_BODY, "s": WS_BODY, "d": r"\p{Nd}"}.get(e, c + e))
            else:
                out.append({"w": W, "s": WS, "S": NWS, "W": NW, "d": r"\p{Nd}"}.get(e, c + e))
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "]" and in_class:
            in_class = False
        out.append({"\x00": _GAP, "\x01": f"(?:^|{NW})", "\x02": f"(?:{NW}|$)"}.get(c, c))
        i += 1
    body = "".join(out)
    return f"(?i:{body})" if ignore_case else body


def re2_any(patterns: list[str], ignore_case: bool = False) -> str:
    body = "|".join(f"(?:{re2(p)})" for p in patterns)
    return f"(?i:{body})" if ignore_case else body


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------------------
# Fixture CTEs
# ---------------------------------------------------------------------------

FIXTURE = """
fx_nd AS (SELECT count(*) AS n FROM documents),
fx_oc AS (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey),
accounts AS (
  SELECT CAST(30 + c.c_custkey % 4 AS BIGINT) AS dataset_id,
         CAST(c.c_custkey AS BIGINT) AS id,
         CASE WHEN c.c_custkey % 29 = 3 THEN c.c_name || chr(7)
              WHEN c.c_custkey % 7 = 1 THEN 'Ada Byron'
              WHEN c.c_custkey % 7 = 2 THEN 'Bob 🤖'
              ELSE c.c_name END AS name,
         CASE c.c_custkey % 3 WHEN 0 THEN 'ab_cd' || CAST(c.c_custkey AS VARCHAR)
              WHEN 1 THEN 'User' || CAST(c.c_custkey AS VARCHAR) ELSE 'plain' END AS username,
         CASE c.c_custkey % 4 WHEN 0 THEN NULL
              WHEN 1 THEN c.c_mktsegment || ' | ' || n.n_name || ' | #x'
              WHEN 2 THEN 'see http://a.example' || chr(10) || n.n_name
              ELSE '' END AS description,
         CASE c.c_custkey % 23 WHEN 0 THEN 'O:' || n.n_name || ':O' WHEN 1 THEN ':null:'
              WHEN 2 THEN NULL ELSE n.n_name END AS location,
         CASE WHEN c.c_custkey % 5 = 1 THEN NULL ELSE CAST(oc.n_orders AS BIGINT) END AS tweet_count,
         c.c_acctbal / 1000.0 AS z_score
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN fx_oc oc ON c.c_custkey = oc.o_custkey),
posts AS (
  SELECT CAST(30 + e.user_id % 4 AS BIGINT) AS dataset_id,
         CAST(e.event_id AS BIGINT) AS post_seq,
         CAST(e.user_id AS BIGINT) AS author_id,
         e.ts AS created_at,
         CASE WHEN e.user_id % 2 = 0 THEN 'en' ELSE 'fr' END AS lang,
         (CASE WHEN e.event_id % 997 = 5 THEN 'Here are some of my recent tweets: ' ELSE '' END)
         || coalesce(d.text, '')
         || (CASE WHEN e.event_id % 991 = 7 THEN ' htts://x.example/z' ELSE '' END)
         || (CASE (CASE WHEN e.user_id % 5 = 0 AND e.event_id % 2 = 0 THEN 'click'
                        ELSE e.event_type END)
               WHEN 'click' THEN ' Click https://t.co/x1'
               WHEN 'signup' THEN ' DM me! #Love #Été'
               WHEN 'error' THEN ' @mention why...?'
               WHEN 'purchase' THEN ' just got 🤖 NASA iPhone THe lol'
               ELSE '' END) AS text
  FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id % (SELECT n FROM fx_nd)),
labels_fx AS (
  SELECT DISTINCT CAST(30 + user_id % 4 AS BIGINT) AS dataset_id,
         CAST(user_id AS BIGINT) AS author_id
  FROM events WHERE user_id % 5 = 0)
"""


def with_fixture(*ctes: str) -> str:
    """``WITH <fixture>, <ctes...>`` prefix."""
    parts = [FIXTURE.strip()] + [c.strip() for c in ctes if c.strip()]
    return "WITH " + ",\n".join(parts) + "\n"


def cnt(text: str, pattern: str, ignore_case: bool = False) -> str:
    return f"CAST(len(regexp_extract_all({text}, {q(re2(pattern, ignore_case))})) AS BIGINT)"


def cnt_char(text: str, ch: str) -> str:
    return f"CAST(length({text}) - length(replace({text}, {q(ch)}, '')) AS BIGINT)"


def has(text: str, pattern: str, ignore_case: bool = False) -> str:
    return f"regexp_matches({text}, {q(re2(pattern, ignore_case))})"


def has_any(text: str, patterns: list[str], ignore_case: bool = False) -> str:
    return f"regexp_matches({text}, {q(re2_any(patterns, ignore_case))})"


def toks(text: str) -> str:
    return f"regexp_extract_all({text}, {q(NWS + '+')})"


def r6(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) AS {name}"


def i8(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


# ---------------------------------------------------------------------------
# Per-post features as SQL (shared by several oracles)
# ---------------------------------------------------------------------------

def post_features_cte(name: str = "pf") -> str:
    t = "coalesce(p.text, '')"
    tags = f"regexp_extract_all({t}, {q(re2(P.HASHTAG_PATTERN))})"
    bait = (f"CASE WHEN p.lang = 'en' THEN {has_any(t, P.EN_BAIT_PATTERNS, True)} "
            f"ELSE {has_any(t, P.FR_BAIT_PATTERNS, True)} END")
    return f"""
{name}_0 AS (
  SELECT p.dataset_id, p.post_seq, p.author_id, p.created_at, p.lang, {t} AS text,
    {cnt(t, P.URL_PATTERN)} AS url_count,
    CAST(len({tags}) AS BIGINT) AS hashtag_count,
    {cnt(t, P.MENTION_PATTERN)} AS mention_count,
    {cnt(t, P.EMOJI_PATTERN)} AS emoji_count,
    CAST(length({t}) AS BIGINT) AS char_len,
    CAST(len({toks(t)}) AS BIGINT) AS word_count,
    CAST(length(regexp_replace({t}, '\\P{{Lu}}+', '', 'g')) AS DOUBLE)
      / greatest(length(regexp_replace({t}, '\\P{{L}}+', '', 'g')), 1) AS caps_ratio,
    {cnt_char(t, '!')} AS excl_count,
    {cnt_char(t, '?')} AS quest_count,
    {cnt(t, r'\.\.\.')} AS ellipsis_count,
    CAST({bait} AS BIGINT) AS has_bait,
    CAST({has_any(t, P.GENERIC_HASHTAG_PATTERNS, True)} AS BIGINT) AS has_generic_hashtag,
    {cnt_char(t, chr(10))} AS newline_count,
    list_transform({tags}, lambda x: lower(x)) AS hashtags
  FROM posts p),
{name} AS (
  SELECT *, CAST(url_count > 0 AS BIGINT) AS has_url,
         CAST(hashtag_count > 0 AS BIGINT) AS has_hashtag,
         CAST(mention_count > 0 AS BIGINT) AS has_mention
  FROM {name}_0)
"""


# ---------------------------------------------------------------------------
# Shared oracle CTEs over eligible posts
# ---------------------------------------------------------------------------

EPOSTS = """
eposts AS (
  SELECT p.* FROM posts p
  SEMI JOIN accounts a ON a.dataset_id = p.dataset_id AND a.id = p.author_id)
"""

TEMPORAL = """
tt AS (SELECT dataset_id, author_id, epoch_us(created_at) AS us, hour(created_at) AS hr
       FROM eposts),
td AS (SELECT dataset_id, author_id,
              us - lag(us) OVER (PARTITION BY dataset_id, author_id ORDER BY us) AS d
       FROM tt),
thc AS (SELECT dataset_id, author_id, hr, count(*) AS c FROM tt GROUP BY ALL),
thp AS (SELECT dataset_id, author_id, count(*) AS n, min(us) AS first_us, max(us) AS last_us,
               count_if(hr <= 6) AS night
        FROM tt GROUP BY ALL),
tent AS (SELECT h.dataset_id, h.author_id,
                -sum((h.c / p.n) * log2(h.c / p.n)) AS hour_entropy,
                count(*) AS active_hours
         FROM thc h JOIN thp p USING (dataset_id, author_id) GROUP BY ALL),
tds AS (SELECT d.dataset_id, d.author_id,
               avg(d) / 1e6 AS mean_s, stddev_pop(d) / 1e6 AS std_s,
               min(d) / 1e6 AS min_s, max(d) / 1e6 AS max_s, median(d) / 1e6 AS med_s,
               avg(CASE WHEN d < 60000000 THEN 1 ELSE 0 END) AS rapid,
               avg(CASE WHEN m > 0 AND abs(d - m) < 0.1 * m THEN 1 ELSE 0 END) AS regular
        FROM (SELECT td.*, (p.last_us - p.first_us) / (p.n - 1) AS m
              FROM td JOIN thp p USING (dataset_id, author_id)
              WHERE td.d IS NOT NULL) d
        GROUP BY ALL),
temporal AS (
  SELECT p.dataset_id, p.author_id, p.n,
    CASE WHEN p.n >= 2 THEN s.mean_s ELSE 0 END AS inter_tweet_mean,
    CASE WHEN p.n >= 2 THEN s.std_s ELSE 0 END AS inter_tweet_std,
    CASE WHEN p.n >= 2 THEN s.std_s / greatest(s.mean_s, 1) ELSE 0 END AS inter_tweet_cv,
    CASE WHEN p.n >= 2 THEN s.min_s ELSE 0 END AS inter_tweet_min,
    CASE WHEN p.n >= 2 THEN s.max_s ELSE 0 END AS inter_tweet_max,
    CASE WHEN p.n >= 2 THEN s.med_s ELSE 0 END AS inter_tweet_median,
    CASE WHEN p.n >= 2 THEN p.n / (greatest((p.last_us - p.first_us) / 1e6, 1) / 3600.0)
         ELSE 0 END AS posts_per_hour,
    CASE WHEN p.n >= 2 THEN e.hour_entropy + 0.0 ELSE 0 END AS hour_entropy,
    CASE WHEN p.n >= 2 THEN p.night / p.n ELSE 0 END AS night_ratio,
    CASE WHEN p.n >= 2 THEN s.rapid ELSE 0 END AS rapid_fire_ratio,
    CASE WHEN p.n >= 2 THEN s.regular ELSE 0 END AS regular_interval_ratio,
    CASE WHEN p.n >= 2 THEN (s.std_s - s.mean_s) / greatest(s.std_s + s.mean_s, 1)
         ELSE 0 END AS temporal_burstiness,
    CASE WHEN p.n >= 2 THEN e.active_hours ELSE 1 END AS active_hours,
    CASE WHEN p.n >= 2 THEN s.max_s / greatest((p.last_us - p.first_us) / 1e6, 1)
         ELSE 0 END AS max_gap_ratio,
    CASE WHEN p.n >= 2 THEN greatest((p.last_us - p.first_us) / 1e6, 1) / 3600.0
         ELSE 0 END AS posting_span_hours
  FROM thp p LEFT JOIN tds s USING (dataset_id, author_id)
  LEFT JOIN tent e USING (dataset_id, author_id))
"""

_PUNCT_SQL = " + ".join(
    f"max(CASE WHEN contains(t, {q(ch)}) THEN 1 ELSE 0 END)" for ch in P.PUNCTUATION_CHARS)


def style_cte() -> str:
    t = "coalesce(text, '')"
    mid = r"\p{Ll}\p{Lu}.|.\p{Lu}\p{Ll}"
    return f"""
sflags AS (
  SELECT dataset_id, author_id, post_seq, {t} AS t, length({t}) AS char_len,
    CAST({has(t, P.FORMAL_PATTERN, True)} AS INT) AS formal,
    CAST({has(t, P.SLANG_PATTERN, True)} AS INT) AS slang,
    CAST(regexp_matches({t}, {q('^' + WS + '*(?:just|Just)' + WS + '+' + NWS)}) AS INT) AS just_start,
    CAST(regexp_matches({t}, {q('[.!?]' + WS + '*$')}) AS INT) AS complete,
    CAST(contains({t}, 'http') OR contains({t}, 't.co') AS INT) AS has_url_text,
    CAST({has(t, P.AI_PHRASE_PATTERN, True)} AS INT) AS ai_phrase,
    CAST(len(list_filter({toks(t)}, lambda w: regexp_matches(w, {q(mid)}))) >= 2 AS INT) AS mid_caps,
    CAST({has(t, P.GENERIC_LIFE_PATTERN, True)} AS INT) AS generic_life,
    CAST(length({t}) < 60 AND NOT (contains({t}, 'http') OR contains({t}, '@')
         OR contains({t}, '#')) AS INT) AS short_generic,
    nullif(lower(regexp_extract({t}, {q('^' + WS + '*(' + NWS + '+)')}, 1)), '') AS first_word
  FROM eposts),
sratio AS (
  SELECT dataset_id, author_id, count(*) AS n_posts,
    avg(formal) AS formality_score, avg(slang) AS slang_ratio,
    avg(just_start) AS just_starter_ratio, avg(complete) AS avg_sentence_completeness,
    avg(has_url_text) AS url_consistency, avg(ai_phrase) AS ai_phrase_ratio,
    avg(mid_caps) AS artificial_caps_ratio, avg(generic_life) AS generic_life_ratio,
    avg(short_generic) AS short_generic_ratio,
    {_PUNCT_SQL} AS punctuation_diversity,
    CASE WHEN count(*) >= 2 THEN stddev_pop(char_len) / greatest(avg(char_len), 1) ELSE 0 END
      AS char_len_cv,
    avg(char_len) AS len_mean
  FROM sflags GROUP BY ALL),
suni AS (
  SELECT f.dataset_id, f.author_id,
    CASE WHEN any_value(s.n_posts) >= 2
         THEN sum(CASE WHEN abs(f.char_len - s.len_mean) < 0.5 * s.len_mean THEN 1 ELSE 0 END)
              / any_value(s.n_posts)
         ELSE 1.0 END AS tweet_len_uniformity
  FROM sflags f JOIN sratio s USING (dataset_id, author_id) GROUP BY ALL),
sfirst AS (
  SELECT dataset_id, author_id, count(DISTINCT first_word) / count(*) AS unique_first_words
  FROM sflags GROUP BY ALL)
"""


def tokens_cte() -> str:
    return f"""
tok AS (SELECT dataset_id, author_id, unnest({toks("lower(coalesce(text, ''))")}) AS token
        FROM eposts),
tcnt AS (SELECT dataset_id, author_id, token, count(*) AS c FROM tok GROUP BY ALL),
rich AS (
  SELECT dataset_id, author_id, count(*) AS vocab, sum(c) AS total,
    count_if(c = 1) AS hapax, sum(c * c) AS m2,
    sum(CASE WHEN regexp_full_match(token, '\\p{{L}}+') THEN c ELSE 0 END) AS n_alpha,
    sum(CASE WHEN regexp_full_match(token, '\\p{{L}}+') THEN c * length(token) ELSE 0 END) AS len_alpha,
    sum(CASE WHEN regexp_full_match(token, '\\p{{L}}+') AND length(token) > 8 THEN c ELSE 0 END)
      AS n_long
  FROM tcnt GROUP BY ALL)
"""


def topics_cte() -> str:
    rows = ", ".join(f"({q(t)}, {q(w)})" for t, ws in P.TOPIC_KEYWORDS.items() for w in ws)
    return f"topics(topic, token) AS (VALUES {rows})"


def tfidf_cte() -> str:
    return f"""
xterms AS (SELECT dataset_id, author_id,
                  unnest(regexp_extract_all(lower(coalesce(text, '')), {q(W + '{2,}')})) AS term
           FROM eposts),
xtc AS (SELECT dataset_id, author_id, term, count(*) AS tf FROM xterms GROUP BY ALL),
xsizes AS (SELECT dataset_id, count(DISTINCT author_id) AS n FROM eposts GROUP BY ALL),
xst AS (SELECT dataset_id, term, count(*) AS df, sum(tf) AS ctf FROM xtc GROUP BY ALL),
xkept AS (SELECT xst.*, s.n FROM xst JOIN xsizes s USING (dataset_id)
          WHERE df >= 2 AND df <= 0.95 * n AND 0.95 * n >= 2),
xvocab AS (SELECT dataset_id, term, df, rnk - 1 AS idx, ln((1.0 + n) / (1.0 + df)) + 1 AS idf
           FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id
                                              ORDER BY ctf DESC, term ASC) AS rnk FROM xkept)
           WHERE rnk <= 3000),
xw AS (SELECT t.dataset_id, t.author_id, v.idx, t.tf * v.idf AS w
       FROM xtc t JOIN xvocab v USING (dataset_id, term)),
xnrm AS (SELECT dataset_id, author_id, sqrt(sum(w * w)) AS nrm FROM xw GROUP BY ALL),
xu AS (SELECT w.dataset_id, w.author_id, w.idx, w.w / n.nrm AS u
       FROM xw w JOIN xnrm n USING (dataset_id, author_id)),
xpairs AS (SELECT a.dataset_id, a.author_id, b.author_id AS other, sum(a.u * b.u) AS sim
           FROM xu a JOIN xu b ON a.dataset_id = b.dataset_id AND a.idx = b.idx
                AND a.author_id <> b.author_id
           GROUP BY ALL),
xsim AS (SELECT e.dataset_id, e.author_id,
                coalesce(sum(p.sim), 0) / any_value(s.n) AS cross_user_sim_mean,
                coalesce(max(p.sim), 0) AS cross_user_sim_max
         FROM (SELECT DISTINCT dataset_id, author_id FROM eposts) e
         JOIN xsizes s USING (dataset_id)
         LEFT JOIN xpairs p USING (dataset_id, author_id)
         GROUP BY ALL)
"""


RN = """
rn AS (SELECT dataset_id, author_id, text,
              row_number() OVER (PARTITION BY dataset_id, author_id ORDER BY post_seq) AS rn
       FROM eposts)
"""


def jaccard_cte() -> str:
    return f"""
ts AS (SELECT dataset_id, author_id, rn,
              list_distinct({toks("lower(coalesce(text, ''))")}) AS ws FROM rn WHERE rn <= 41),
jp AS (SELECT a.dataset_id, a.author_id,
              len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))) AS j
       FROM ts a JOIN ts b ON a.dataset_id = b.dataset_id AND a.author_id = b.author_id
            AND b.rn = a.rn + 1
       WHERE a.rn <= 40 AND len(list_distinct(list_concat(a.ws, b.ws))) > 0),
jacf AS (SELECT a.dataset_id, a.author_id,
                coalesce(avg(j), 0) AS content_jaccard_mean,
                coalesce(stddev_pop(j), 0) AS content_jaccard_std
         FROM (SELECT DISTINCT dataset_id, author_id FROM eposts) a
         LEFT JOIN jp USING (dataset_id, author_id) GROUP BY ALL)
"""


def bigram_cte() -> str:
    return f"""
tk AS (SELECT dataset_id, author_id, rn, {toks("lower(coalesce(text, ''))")} AS w
       FROM rn WHERE rn <= 34),
bg AS (SELECT dataset_id, author_id, rn,
              list_distinct(list_transform(range(1, len(w)),
                                           lambda i: w[i] || ' ' || w[i + 1])) AS b
       FROM tk),
cmp AS (SELECT a.dataset_id, a.author_id, len(list_intersect(a.b, c.b)) AS ov
        FROM bg a JOIN bg c ON a.dataset_id = c.dataset_id AND a.author_id = c.author_id
             AND c.rn BETWEEN a.rn + 1 AND a.rn + 4
        WHERE a.rn <= 30 AND len(a.b) > 0 AND len(c.b) > 0),
bigf AS (SELECT a.dataset_id, a.author_id,
                coalesce(sum(ov), 0) / greatest(count(ov), 1) AS repeated_phrase_ratio
         FROM (SELECT DISTINCT dataset_id, author_id FROM eposts) a
         LEFT JOIN cmp USING (dataset_id, author_id) GROUP BY ALL)
"""


HASHTAGS = """
htagf AS (
  SELECT b.dataset_id, b.author_id, b.total AS total_hashtags,
    coalesce(u.uq, 0) AS unique_hashtags,
    coalesce(u.uq, 0) / greatest(b.total, 1) AS hashtag_diversity,
    b.total / b.n AS hashtag_per_post, b.mx AS max_hashtags_per_tweet,
    b.w / b.n AS hashtag_post_ratio
  FROM (SELECT dataset_id, author_id, count(*) AS n, sum(hashtag_count) AS total,
               max(hashtag_count) AS mx, sum(has_hashtag) AS w FROM pf GROUP BY ALL) b
  LEFT JOIN (SELECT dataset_id, author_id, count(DISTINCT tag) AS uq
             FROM (SELECT dataset_id, author_id, unnest(hashtags) AS tag FROM pf) GROUP BY ALL) u
  USING (dataset_id, author_id))
"""

RICH = """
richf AS (
  SELECT dataset_id, author_id,
    vocab / greatest(total, 1) AS ttr,
    hapax / greatest(vocab, 1) AS hapax_ratio,
    10000.0 * (m2 - greatest(total, 1)) / greatest(greatest(total, 1) * greatest(total, 1), 1)
      AS vocab_richness,
    CASE WHEN n_alpha > 0 THEN len_alpha / n_alpha ELSE 0 END AS avg_word_len,
    n_long / greatest(n_alpha, 1) AS long_word_ratio
  FROM rich)
"""

TOPICF = """
topicf AS (
  SELECT a.dataset_id, a.author_id, coalesce(h.nt, 0) / 7.0 AS topic_diversity
  FROM (SELECT DISTINCT dataset_id, author_id FROM tcnt) a
  LEFT JOIN (SELECT dataset_id, author_id, count(DISTINCT topic) AS nt
             FROM tcnt JOIN topics USING (token) GROUP BY ALL) h USING (dataset_id, author_id))
"""


def rollup_cte(numeric: list[str], dispersion: tuple[str, ...]) -> str:
    cols = []
    for k in numeric:
        cols += [f"avg({k}) AS {k}_mean", f"sum({k}) AS {k}_sum"]
        if k in dispersion:
            cols += [f"stddev_pop({k}) AS {k}_std", f"max({k}) AS {k}_max"]
    return ("rollf AS (SELECT dataset_id, author_id, count(*) AS n_posts, "
            + ", ".join(cols) + " FROM pf GROUP BY ALL)")

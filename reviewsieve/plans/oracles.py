"""The same results in plain SQL, for comparison by another engine.

Each statement is put together from named common table expressions. They follow
the definitions directly (unnested tokens, window functions, joins of pairs) and
share no expression with the DataFrame code.
"""
from __future__ import annotations

from .. import lexicons as lx
from ..sources.views import REVIEWS_ORDERS_SQL
from .queries import EVIDENCE, INTERCEPT, dense_coefficient

ORACLES: dict[str, str] = {}


# --------------------------------------------------------------------------- building blocks
def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def among(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def r6(expr: str, name: str | None = None) -> str:
    return f"round({expr}, 6) + 0.0 AS {name or expr}"


def values(rows, columns: str, name: str) -> str:
    return f"{name} AS (SELECT * FROM (VALUES {', '.join(rows)}) AS v({columns}))"


def stack(*ctes: str, final: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(c for c in ctes if c) + "\n" + final


RO = "ro AS (" + REVIEWS_ORDERS_SQL.format(orders="orders") + ")"
RD = """rd AS (SELECT source AS product_id, doc_id AS review_id, CAST(1 + doc_id % 5 AS DOUBLE) AS rating,
  toxic AS label, lang AS category, text FROM documents LEFT JOIN labels USING (doc_id))"""
RT = """rt AS (SELECT conv_id AS product_id, conv_id * 1000 + turn AS review_id, CAST(NULL AS DOUBLE) AS rating, text
  FROM conversations)"""
WORD = q(lx.WORD)
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
CLAUSE = q(lx.CLAUSE_BREAK.replace("(?iU)", "(?i)"))
TERM = q(lx.TERM_TOKEN)


def pieces(source: str, keys: str, column: str, array: str, number: str, name: str, out: str) -> str:
    """Stripped, non-empty elements of an array expression as rows numbered from 0."""
    stripped = f"list_filter(list_transform({array}, lambda x: {STRIP.format('x')}), lambda x: x <> '')"
    return f"""{out} AS (SELECT {keys}, CAST(unnest(range(len(a))) AS INT) AS {number}, unnest(a) AS {name}
      FROM (SELECT {keys}, {stripped} AS a FROM {source}))"""


def sentences(source: str, out: str = "se") -> str:
    array = r"string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+')"
    return pieces(source, "product_id, review_id", "text", array, "sent_no", "sentence", out)


def clauses(source: str = "se", out: str = "cl") -> str:
    return pieces(source, "product_id, review_id, sent_no, sentence", "sentence",
                  f"string_split_regex(sentence, {CLAUSE})", "clause_no", "clause", out)


def segments(source: str = "cl", out: str = "sg") -> str:
    return pieces(source, "product_id, review_id, sent_no, clause_no", "clause",
                  r"string_split_regex(clause, ',|\s+-\s+')", "seg_no", "segment", out)


def tokens(source: str, keys: str, out: str, column: str = "text") -> str:
    """Lower-case words as rows, ``i`` from 1."""
    return f"""{out} AS (SELECT {keys}, unnest(range(1, len(w) + 1)) AS i, lower(unnest(w)) AS tok
      FROM (SELECT {keys}, regexp_extract_all({column}, {WORD}) AS w FROM {source}))"""


def phrase_steps(source: str, p: str) -> list[str]:
    out = [f"{p}0 AS (SELECT id, text AS t, CAST(0 AS DOUBLE) AS ph FROM {source})"]
    for k, (pattern, value) in enumerate(lx.PHRASES):
        out.append(f"""{p}{k + 1} AS (SELECT id, regexp_replace(t, {q(pattern)}, ' ', 'gi') AS t,
          ph + {value} * len(regexp_extract_all(t, {q('(?i)' + pattern)})) AS ph FROM {p}{k})""")
    return out


def sentiment(source: str, out: str) -> list[str]:
    """``out(id, s)`` from ``source(id, text)``; also ``out_v(id, i, tok, v)``."""
    p = out + "_"
    last = f"{p}{len(lx.PHRASES)}"
    word = " ".join(f"WHEN {q(w)} THEN {v}" for w, v in (lx.POSITIVE | lx.NEGATIVE).items())
    boost = " ".join(f"WHEN {q(w)} THEN {v}" for w, v in lx.BOOSTERS.items())
    return phrase_steps(source, p) + [
        tokens(last, "id", p + "tk", "t"),
        f"""{p}fl AS (SELECT id, i, tok, lag(tok) OVER (PARTITION BY id ORDER BY i) AS prev,
          max(CASE WHEN tok IN {among(lx.CONTRAST)} THEN i END) OVER (PARTITION BY id) AS lastbut,
          max(CASE WHEN tok IN {among(lx.NEGATORS)} OR ends_with(tok, {q(lx.NEGATOR_SUFFIX)}) THEN 1 ELSE 0 END)
            OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS neg
          FROM {p}tk)""",
        f"""{out}_v AS (SELECT id, i, tok, CAST(CASE tok {word} END AS DOUBLE)
          * coalesce(CAST(CASE prev {boost} END AS DOUBLE), 1) * CASE WHEN neg = 1 THEN -0.74 ELSE 1 END
          * CASE WHEN lastbut IS NULL THEN 1 WHEN i > lastbut THEN 1.5 ELSE 0.5 END AS v FROM {p}fl)""",
        f"""{p}tt AS (SELECT id, t, round(ph + coalesce(sv, 0), 12) AS tot FROM {last}
          LEFT JOIN (SELECT id, sum(v) AS sv FROM {out}_v GROUP BY id) USING (id))""",
        f"""{p}ex AS (SELECT id, CASE WHEN tot = 0 THEN 0 ELSE tot + sign(tot) * 0.29
          * least(length(t) - length(replace(t, '!', '')), 4) END AS x FROM {p}tt)""",
        f"{out} AS (SELECT id, x / sqrt(x * x + 15) AS s FROM {p}ex)",
    ]


def style(source: str, out: str = "st") -> list[str]:
    def share(words) -> str:
        return f"len(list_filter(lw, lambda w: w IN {among(words)})) / n1"
    punct = "regexp_replace(text, '[^,;:()\"''-]', '', 'g')"
    return [
        f"""{out}_w AS (SELECT review_id, text, w, list_transform(w, lambda x: lower(x)) AS lw, len(w) AS n,
          greatest(len(w), 1) AS n1 FROM (SELECT review_id, text, regexp_extract_all(text, {WORD}) AS w
          FROM {source}))""",
        sentences(source, out + "_se"),
        f"""{out}_s AS (SELECT review_id, unnest(CASE WHEN ss IS NULL THEN [text] ELSE ss END) AS s
          FROM {source} LEFT JOIN (SELECT review_id, list(sentence) AS ss FROM {out}_se GROUP BY review_id)
          USING (review_id))""",
        f"""{out}_l AS (SELECT review_id, count(*) AS ns, avg(len(regexp_extract_all(s, {WORD}))) AS m,
          stddev_pop(len(regexp_extract_all(s, {WORD}))) AS sd,
          avg(CASE WHEN regexp_matches(s, '^\\p{{Ll}}') THEN 1 ELSE 0 END) AS lo FROM {out}_s GROUP BY review_id)""",
        f"""{out}_c AS (SELECT review_id, unnest(range(len(c))) AS i, unnest(c) AS ch
          FROM (SELECT review_id, string_split(text, '') AS c FROM {source}))""",
        f"""{out}_r AS (SELECT review_id, ch, count(*) AS k FROM (SELECT *, i - row_number() OVER
          (PARTITION BY review_id, ch ORDER BY i) AS g FROM {out}_c) WHERE ch <> chr(10)
          GROUP BY review_id, ch, g HAVING count(*) >= 3)""",
        f"{out}_rr AS (SELECT review_id, count(*) AS reps FROM {out}_r GROUP BY review_id)",
        f"""{out} AS (SELECT review_id, ln(1 + n) AS n_words, CAST(ns AS DOUBLE) AS n_sentences,
          CASE WHEN n > 0 THEN length(array_to_string(w, '')) / n ELSE 0 END AS avg_word_len,
          m AS avg_sent_len, sd AS sent_len_std, len(list_distinct(lw)) / n1 AS type_token_ratio,
          {share(lx.STOPWORDS)} AS stopword_ratio, {share(lx.FIRST_PERSON)} AS first_person_ratio,
          {share(lx.SECOND_PERSON)} AS second_person_ratio, {share(lx.SUPERLATIVES)} AS superlative_ratio,
          {share(lx.HEDGES)} AS hedge_ratio,
          CAST(length(text) - length(replace(text, '!', '')) AS DOUBLE) AS exclamations,
          CAST(length(text) - length(replace(text, '?', '')) AS DOUBLE) AS questions,
          length({punct}) / n1 AS punct_ratio,
          length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g'))
            / greatest(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')), 1) AS upper_ratio,
          length(regexp_replace(text, '[^\\p{{Nd}}]', '', 'g')) / greatest(length(text), 1) AS digit_ratio,
          lo AS lowercase_sentence_starts, CAST(coalesce(reps, 0) AS DOUBLE) AS repeated_chars
          FROM {out}_w JOIN {out}_l USING (review_id) LEFT JOIN {out}_rr USING (review_id))""",
    ]


def bigrams(source: str, out: str, keys: str = "review_id") -> str:
    """Neighbouring tokens with both boundary marks."""
    return f"""{out} AS (SELECT {keys}, unnest(t[:-2]) AS prev, unnest(t[2:]) AS cur FROM (SELECT {keys},
      list_concat(['<s>'], list_transform(regexp_extract_all(text, {WORD}), lambda x: lower(x)), ['</s>']) AS t
      FROM {source}))"""


def all_tokens(source: str, out: str, keys: str) -> str:
    return f"""{out} AS (SELECT {keys}, unnest(list_concat(['<s>'],
      list_transform(regexp_extract_all(text, {WORD}), lambda x: lower(x)), ['</s>'])) AS token FROM {source})"""


def perplexity(train: str, score: str, out: str = "lp") -> list[str]:
    p = out + "_"
    return [
        bigrams(train, p + "tb"), all_tokens(train, p + "tt", "review_id"), bigrams(score, p + "sb"),
        f"{p}b AS (SELECT prev, cur, count(*) AS c FROM {p}tb GROUP BY prev, cur)",
        f"{p}u AS (SELECT token, count(*) AS c FROM {p}tt GROUP BY token)",
        f"{p}n AS (SELECT sum(c) AS total, count(*) + 1 AS v FROM {p}u)",
        f"""{out} AS (SELECT review_id, -avg(ln(0.7 * coalesce(b.c / up.c, 0)
          + 0.3 * (coalesce(uc.c, 0) + 1) / (total + v))) AS log_perplexity
          FROM {p}sb s LEFT JOIN {p}b b ON s.prev = b.prev AND s.cur = b.cur
          LEFT JOIN {p}u up ON s.prev = up.token LEFT JOIN {p}u uc ON s.cur = uc.token, {p}n GROUP BY review_id)""",
    ]


def term_counts(source: str, out: str = "tc") -> str:
    return f"""{out} AS (SELECT review_id, term, count(*) AS n FROM (SELECT review_id, unnest(list_concat(t,
      list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term
      FROM (SELECT review_id, regexp_extract_all(lower(text), {TERM}) AS t FROM {source})) GROUP BY review_id, term)"""


def vocab(source: str, counts: str = "tc", out: str = "vo", limit: int = 50000) -> list[str]:
    return [
        f"{out}_n AS (SELECT count(*) AS nd FROM {source})",
        f"""{out}_k AS (SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS cf FROM {counts} GROUP BY term
          HAVING count(*) >= 2 AND count(*) <= 0.9 * (SELECT nd FROM {out}_n) ORDER BY cf DESC, term LIMIT {limit})""",
        f"""{out} AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx, df, cf,
          ln((1 + nd) / (1 + df)) + 1 AS idf FROM {out}_k, {out}_n)""",
    ]


def tfidf(counts: str = "tc", vocabulary: str = "vo", out: str = "tw") -> str:
    return f"""{out} AS (SELECT review_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY review_id)) AS w
      FROM (SELECT review_id, term, (1 + ln(n)) * idf AS w FROM {counts} JOIN {vocabulary} USING (term)))"""


COEF = "((length(term) * 7 + unicode(term) * 3) % 13 - 6) / 4.0"
DENSE = lx.DENSE_FEATURES


def dense() -> list[str]:
    """``de``: the 22 features of the composed reviews."""
    return style("ro") + perplexity("(SELECT * FROM ro WHERE label = 0)", "ro") + [
        "sx AS (SELECT review_id AS id, text FROM ro)", *sentiment("sx", "sn"),
        f"""de AS (SELECT review_id, product_id, rating, label, text, {', '.join(lx.STYLE_FEATURES)}, log_perplexity,
          s AS sentiment, coalesce(abs(rating - 3) / 2, 0) AS rating_extremity,
          coalesce(abs((rating - 3) / 2 - s) / 2, 0) AS rating_mismatch
          FROM ro JOIN st USING (review_id) JOIN lp USING (review_id) JOIN sn ON sn.id = review_id)""",
        "mo AS (SELECT " + ", ".join(
            f"avg({f}) AS m_{f}, CASE WHEN stddev_pop({f}) > 1e-12 THEN stddev_pop({f}) ELSE 1 END AS s_{f}"
            for f in DENSE) + " FROM de)",
        "zz AS (SELECT review_id, " + ", ".join(f"({f} - m_{f}) / s_{f} AS z_{f}" for f in DENSE) + " FROM de, mo)",
    ]


def scored() -> list[str]:
    """``sc``: composed reviews with ``p``, and ``co`` / ``zz`` behind it."""
    linear = " + ".join(f"z_{f} * {dense_coefficient(i)}" for i, f in enumerate(DENSE))
    return [RO, *dense(), term_counts("ro"), *vocab("ro"), tfidf(),
            f"co AS (SELECT review_id, term, w * {COEF} AS c FROM tw)",
            f"""sc AS (SELECT de.product_id, review_id, de.rating, label, text, sentiment,
              1 / (1 + exp(-(coalesce(zt, 0) + {linear} + {INTERCEPT}))) AS p FROM de JOIN zz USING (review_id)
              LEFT JOIN (SELECT review_id, sum(c) AS zt FROM co GROUP BY review_id) USING (review_id))"""]


def oracle(name: str, *ctes: str, final: str, recursive: bool = False) -> None:
    ORACLES[name] = stack(*ctes, final=final, recursive=recursive) if ctes else final


# --------------------------------------------------------------------------- ingest
oracle("s1_reviews", final="""SELECT source AS product_id, doc_id AS review_id, text,
  CAST(1 + doc_id % 5 AS DOUBLE) AS rating FROM documents""")
oracle("s2_labelled", final="""SELECT source AS product_id, doc_id AS review_id, text, CAST(NULL AS DOUBLE) AS rating,
  CAST(coalesce(toxic = 1, false) AS INT) AS label, lang AS category FROM documents LEFT JOIN labels USING (doc_id)""")
oracle("s4_rating_cast", final="""SELECT o_orderkey AS review_id, CASE o_orderkey % 9 WHEN 2 THEN 5.0 WHEN 7 THEN 3.5
  WHEN 6 THEN -CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DOUBLE)
  WHEN 8 THEN CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DOUBLE) END AS rating FROM orders""")
oracle("s5_label_norm", final="""SELECT o_orderkey AS review_id,
  CAST(o_orderkey % 9 IN (0, 2, 3, 4, 6) AS INT) AS label FROM orders""")
oracle("s8_split", RO, final="""SELECT label, split, n FROM (SELECT label, count(*) AS c,
  CAST(round(count(*) * 0.2) AS BIGINT) AS t FROM ro GROUP BY label),
  LATERAL (SELECT 'test' AS split, t AS n UNION ALL SELECT 'train', c - t)""")

DRAWN = "md5('{seed}|' || review_id), review_id"
oracle("s7_sample", RO, final=f"SELECT * FROM ro ORDER BY {DRAWN.format(seed=lx.SPLIT_SEED)} LIMIT 1000")
oracle("s8_split_rows", RO, final=f"""SELECT review_id, label, CASE WHEN row_number() OVER (PARTITION BY label
  ORDER BY {DRAWN.format(seed=lx.SPLIT_SEED)}) <= round(count(*) OVER (PARTITION BY label) * {lx.TEST_SHARE})
  THEN 'test' ELSE 'train' END AS split FROM ro""")

# --------------------------------------------------------------------------- text
oracle("t1_sentences", RD, sentences("rd"), final="SELECT * FROM se")
oracle("t2_clauses", RO, sentences("ro"), clauses(),
       final="SELECT product_id, review_id, sent_no, clause_no, clause FROM cl")
oracle("t3_segments", RO, sentences("ro"), clauses(), segments(), final="SELECT * FROM sg")
oracle("t4_words", final=f"""SELECT doc_id AS review_id, CAST(unnest(range(len(w))) AS INT) AS pos, unnest(w) AS word
  FROM (SELECT doc_id, regexp_extract_all(text, {WORD}) AS w FROM documents)""")
oracle("t5_tokens", RO, tokens("ro", "review_id", "tk"), final="SELECT review_id, CAST(i - 1 AS INT) AS pos, tok AS token FROM tk")


def span_pattern(phrase: str) -> str:
    return q(r"(?i)\b" + r"\W+".join(phrase.split()) + r"\b")


def spans(source: str, key: str, column: str, pattern: str, extra: str = "") -> str:
    """(key, b, e[, hit]) of all matches, from the lengths of gaps and hits."""
    return f"""SELECT {key}, b, b + length(hit) AS e, hit{extra} FROM (SELECT {key},
      unnest(list_transform(range(1, len(h) + 1), lambda k: CAST(list_sum(list_transform(g[1:k], lambda x: length(x)))
        + coalesce(list_sum(list_transform(h[1:k - 1], lambda x: length(x))), 0) AS BIGINT))) AS b, unnest(h) AS hit
      FROM (SELECT {key}, regexp_extract_all({column}, {pattern}) AS h,
        string_split_regex({column}, {pattern}) AS g FROM {source} WHERE regexp_matches({column}, {pattern})))"""


MERGED = [
    """si AS (SELECT review_id, b, e, CASE WHEN b <= max(e) OVER (PARTITION BY review_id ORDER BY b, e
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM sp)""",
    """sj AS (SELECT review_id, b, e, sum(fresh) OVER (PARTITION BY review_id ORDER BY b, e ROWS UNBOUNDED
      PRECEDING) AS g FROM si)""",
    'ss AS (SELECT review_id, CAST(min(b) AS INT) AS "start", CAST(max(e) AS INT) AS stop FROM sj GROUP BY review_id, g)']
SPANS = ["sp AS (" + " UNION ALL ".join(spans("ro", "review_id", "text", span_pattern(p)) for p in EVIDENCE) + ")", *MERGED]
oracle("t6_phrase_spans", RO, *SPANS, final="SELECT * FROM ss")
ESCAPED = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
MARKED = [
    """pt AS (SELECT review_id, "start", stop, coalesce(lag(stop) OVER (PARTITION BY review_id ORDER BY "start"), 0)
      AS since FROM ss)""",
    f"""pj AS (SELECT review_id, string_agg({ESCAPED.format('substr(text, since + 1, "start" - since)')} || '<mark>'
      || {ESCAPED.format('substr(text, "start" + 1, stop - "start")')} || '</mark>', '' ORDER BY "start") AS h,
      max(stop) AS last FROM pt JOIN ro USING (review_id) GROUP BY review_id)"""]
MARKUP = f"coalesce(h, '') || {ESCAPED.format('substr(text, coalesce(last, 0) + 1)')}"
oracle("t6_highlight", RO, *SPANS, *MARKED,
       final=f"SELECT review_id, {MARKUP} AS html FROM ro LEFT JOIN pj USING (review_id)")
oracle("t7_term_tokens", final=f"""SELECT doc_id AS review_id, CAST(unnest(range(len(w))) AS INT) AS pos, unnest(w) AS token
  FROM (SELECT doc_id, regexp_extract_all(lower(text), {TERM}) AS w FROM documents)""")
oracle("t8_ngrams", RO, term_counts("ro"), final="SELECT * FROM tc")

# --------------------------------------------------------------------------- sentiment
SRC_O = "sx AS (SELECT review_id AS id, text FROM ro)"
oracle("n1_phrase_score", RO, SRC_O, *phrase_steps("sx", "p"),
       final=f"SELECT id AS review_id, {r6('ph', 'phrase_total')}, t AS rest FROM p{len(lx.PHRASES)}")
oracle("n5_token_values", RO, SRC_O, *sentiment("sx", "sn"),
       final=f"SELECT id AS review_id, tok AS token, {r6('v', 'value')} FROM sn_v WHERE v IS NOT NULL")
oracle("n7_sentiment", RO, SRC_O, *sentiment("sx", "sn"), final=f"SELECT id AS review_id, {r6('s', 'sentiment')} FROM sn")
oracle("n7_sentiment_docs", "sx AS (SELECT doc_id AS id, text FROM documents)", *sentiment("sx", "sn"),
       final=f"SELECT id AS review_id, {r6('s', 'sentiment')} FROM sn")
oracle("n_product_words", RO, SRC_O, *sentiment("sx", "sn"),
       final=f"""SELECT product_id, tok AS token, count(*) AS n, {r6('sum(v)', 'total')} FROM sn_v
         JOIN ro ON id = review_id WHERE v IS NOT NULL GROUP BY product_id, tok""")

# --------------------------------------------------------------------------- features
STYLE_OUT = ", ".join(r6(f) for f in lx.STYLE_FEATURES)
oracle("f_style", RO, *style("ro"), final=f"SELECT review_id, {STYLE_OUT} FROM st")
oracle("f_style_docs", RD, *style("rd"), final=f"SELECT review_id, {STYLE_OUT} FROM st")
oracle("f21_f22_rating", RO, SRC_O, *sentiment("sx", "sn"),
       final=f"""SELECT review_id, {r6('coalesce(abs(rating - 3) / 2, 0)', 'rating_extremity')},
         {r6('coalesce(abs((rating - 3) / 2 - s) / 2, 0)', 'rating_mismatch')} FROM ro JOIN sn ON id = review_id""")
oracle("f23_dense", RO, *dense(), final=f"SELECT review_id, {', '.join(r6(f) for f in DENSE)} FROM de")
oracle("f24_standardise", RO, *dense(),
       final=f"SELECT review_id, {', '.join(r6(f'z_{f}', f) for f in DENSE)} FROM zz")

# --------------------------------------------------------------------------- language model
GD = "gd AS (SELECT * FROM rd WHERE label = 0)"
oracle("l2_unigrams", RD, GD, all_tokens("gd", "u", "review_id"),
       final="SELECT token, count(*) AS c FROM u GROUP BY token")
oracle("l3_bigrams", RD, GD, bigrams("gd", "b"), final="SELECT prev, cur, count(*) AS c FROM b GROUP BY prev, cur")
oracle("l4_totals", RD, GD, all_tokens("gd", "u", "review_id"),
       final="SELECT count(*) AS total, count(DISTINCT token) + 1 AS v FROM u")
oracle("l4_perplexity", RD, GD, *perplexity("gd", "rd"),
       final=f"SELECT review_id, {r6('log_perplexity')} FROM lp")
_FOLDS = []
for _f in range(5):
    _FOLDS += perplexity(f"(SELECT * FROM ro WHERE label = 0 AND review_id % 5 <> {_f})",
                         f"(SELECT * FROM ro WHERE review_id % 5 = {_f})", f"lp{_f}")
oracle("l5_crossfit", RO, *_FOLDS, final=" UNION ALL ".join(
    f"SELECT review_id, {r6('log_perplexity')} FROM lp{f}" for f in range(5)))
RF = f"rf AS (SELECT *, (row_number() OVER (ORDER BY {DRAWN.format(seed=0)}) - 1) % {lx.FOLDS} AS fold FROM ro)"
_DRAWN = []
for _f in range(lx.FOLDS):
    _DRAWN += perplexity(f"(SELECT * FROM rf WHERE label = 0 AND fold <> {_f})",
                         f"(SELECT * FROM rf WHERE fold = {_f})", f"lp{_f}")
oracle("l5_crossfit_hashed", RO, RF, *_DRAWN, final=" UNION ALL ".join(
    f"SELECT review_id, {r6('log_perplexity')} FROM lp{f}" for f in range(lx.FOLDS)))
oracle("l6_merge", RD, GD, RO, bigrams("gd", "b1"), bigrams("(SELECT * FROM ro WHERE label = 0)", "b2"),
       final="""SELECT prev, cur, count(*) AS c FROM (SELECT prev, cur FROM b1 UNION ALL SELECT prev, cur FROM b2)
         GROUP BY prev, cur""")
oracle("l7_external_perplexity", RT, final=f"""SELECT review_id, {r6('''list_sum(list_transform(string_split(text, ''),
  lambda c: unicode(c))) / greatest(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')), 1)''', 'log_perplexity')} FROM rt""")

# --------------------------------------------------------------------------- vectors and model
oracle("v1_v4_tfidf", RD, term_counts("rd"), *vocab("rd"), tfidf(),
       final=f"SELECT review_id, term, {r6('w', 'value')} FROM tw")
oracle("v3_vocab", RD, term_counts("rd"), *vocab("rd"), final=f"SELECT term, idx, df, cf, {r6('idf')} FROM vo")
oracle("v3_vocab_limited", RD, term_counts("rd"), *vocab("rd", limit=500),
       final=f"SELECT term, idx, df, cf, {r6('idf')} FROM vo")
oracle("v6_unseen_terms", RD, GD, RO, term_counts("gd", "tg"), *vocab("gd", "tg"), term_counts("ro"), tfidf(),
       final=f"SELECT review_id, term, {r6('w', 'value')} FROM tw")
oracle("c1_weights", RO, final=f"""SELECT label, {r6('(SELECT count(*) FROM ro) / (2 * count(*))', 'weight')}
  FROM ro GROUP BY label""")
SC = scored()
oracle("c3_score", *SC, final=f"SELECT review_id, {r6('sentiment')}, {r6('p', 'fake_prob')} FROM sc")
oracle("c4_predict", *SC, final="SELECT review_id, CAST(p >= 0.4 AS INT) AS predicted FROM sc")
oracle("c5_fusion", *SC, final=f"""SELECT review_id, {r6('''CASE WHEN o_orderkey % 3 > 0
  THEN (p + (o_custkey % 100) / 100.0) / 2 ELSE p END''', 'fake_prob')} FROM sc JOIN orders ON o_orderkey = review_id""")
oracle("c6_batch_score", RO, final="""SELECT review_id,
  least(length(text) - length(replace(text, '!', '')), 4) / 4.0 AS p_ext FROM ro""")

# --------------------------------------------------------------------------- explanation
oracle("x1_contributions", *SC, final=f"SELECT review_id, term, {r6('c', 'contribution')} FROM co WHERE c > 0")
TELLING = f"len(list_filter(string_split(term, ' '), lambda w: w NOT IN {among(lx.STOPWORDS)})) > 0"
WORDS_K, WORDS_X = "string_split(k, ' ')", "string_split(x[1], ' ')"
PHRASES = [
    f"""pc AS (SELECT review_id, list([term] ORDER BY c DESC, term) AS l, map_from_entries(list((term, c))) AS m
      FROM co WHERE c > 0 AND {TELLING} GROUP BY review_id)""",
    f"""pk AS (SELECT review_id, m, list_reduce(l, lambda acc, x: CASE WHEN len(acc) >= 6 OR len(list_filter(acc,
      lambda k: list_has_all({WORDS_K}, {WORDS_X}) OR list_has_all({WORDS_X}, {WORDS_K}))) > 0
      THEN acc ELSE list_concat(acc, x) END) AS kept FROM pc)""",
    """ph AS (SELECT review_id, CAST(unnest(range(1, len(kept) + 1)) AS INT) AS rank, unnest(kept) AS phrase,
      unnest(list_transform(kept, lambda k: m[k])) AS weight FROM pk)""",
]
oracle("x2_x4_phrases", *SC, *PHRASES, final=f"SELECT review_id, rank, phrase, {r6('weight')} FROM ph")
REASONS = [
    "ze AS (" + " UNION ALL ".join(
        f"SELECT review_id, {i} AS i, z_{f} * {dense_coefficient(i)} AS c, CASE WHEN z_{f} > 0 THEN {q(lx.REASONS[f][0])} "
        f"ELSE {q(lx.REASONS[f][1])} END AS reason FROM zz" for i, f in enumerate(DENSE)) + ")",
    """re AS (SELECT review_id, CAST(row_number() OVER (PARTITION BY review_id ORDER BY c DESC, i) AS INT) AS rank, reason, c
      FROM ze WHERE c > 0 QUALIFY rank <= 3)""",
]
oracle("x5_reasons", *SC, *REASONS, final=f"SELECT review_id, rank, reason, {r6('c', 'weight')} FROM re")
oracle("x6_global_ngrams", RO, term_counts("ro"), *vocab("ro"), final=f"""
  SELECT 'fake' AS side, CAST(row_number() OVER (ORDER BY {COEF} DESC, term DESC) AS INT) AS rank, term, {r6(COEF, 'coef')}
  FROM vo QUALIFY rank <= 25 UNION ALL
  SELECT 'genuine', CAST(row_number() OVER (ORDER BY {COEF}, term) AS INT) AS rank, term, {r6(COEF, 'coef')} FROM vo
  QUALIFY rank <= 25""")
oracle("x7_dense_weights", values([f"({q(f)}, {dense_coefficient(i)})" for i, f in enumerate(DENSE)], "feature, coef", "d"),
       final="""SELECT feature, CAST(coef AS DOUBLE) AS coef FROM d ORDER BY abs(coef) DESC, feature LIMIT 8""")

# --------------------------------------------------------------------------- metrics
JU = "ju AS (SELECT label, p, CAST(p >= 0.5 AS INT) AS predicted FROM sc)"
CELLS = """ce AS (SELECT CAST(sum(CASE WHEN label = 1 AND predicted = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
  CAST(sum(CASE WHEN label = 0 AND predicted = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
  CAST(sum(CASE WHEN label = 1 AND predicted = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
  CAST(sum(CASE WHEN label = 0 AND predicted = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tn FROM ju)"""
AUC = """(SELECT sum(CASE WHEN label = 1 THEN rk END) - n1 * (n1 + 1) / 2 FROM (SELECT label,
  avg(rn) OVER (PARTITION BY p) AS rk FROM (SELECT label, p, row_number() OVER (ORDER BY p) AS rn FROM {0})))
  / (n1 * n0)"""
COUNTS = """(SELECT CAST(sum(label) AS DOUBLE) AS n1, CAST(sum(1 - label) AS DOUBLE) AS n0 FROM {0})"""
oracle("m1_m2_accuracy_f1", *SC, JU, CELLS, final=f"""SELECT {r6('(tp + tn) / (tp + fp + fn + tn)', 'accuracy')},
  {r6('2 * tp / (2 * tp + fp + fn)', 'f1')} FROM ce""")
oracle("m3_auc", *SC, JU, final=f"SELECT {r6(AUC.format('ju'), 'auc')} FROM {COUNTS.format('ju')}")
oracle("m4_class_report", *SC, JU, CELLS,
       """cr AS (SELECT tn / (tn + fn) AS gp, tn / (tn + fp) AS gr, 2 * tn / (2 * tn + fn + fp) AS gf, tn + fp AS gn,
         tp / (tp + fp) AS fpr, tp / (tp + fn) AS fr, 2 * tp / (2 * tp + fp + fn) AS ff, tp + fn AS fkn,
         tp + fp + fn + tn AS n, (tp + tn) / (tp + fp + fn + tn) AS ac FROM ce)""",
       final=" UNION ALL ".join(
           f"SELECT {q(n)} AS class, {r6(p, 'precision')}, {r6(r, 'recall')}, {r6(f, 'f1')}, CAST({s} AS BIGINT) AS support FROM cr"
           for n, p, r, f, s in [
               ("genuine", "gp", "gr", "gf", "gn"), ("fake", "fpr", "fr", "ff", "fkn"), ("accuracy", "ac", "ac", "ac", "n"),
               ("macro avg", "(gp + fpr) / 2", "(gr + fr) / 2", "(gf + ff) / 2", "n"),
               ("weighted avg", "(gp * gn + fpr * fkn) / n", "(gr * gn + fr * fkn) / n", "(gf * gn + ff * fkn) / n", "n")]))
oracle("m5_split_sizes", RO, """pl AS (SELECT label, count(*) AS c, CAST(round(count(*) * 0.2) AS BIGINT) AS t FROM ro
  GROUP BY label)""", """pm AS (SELECT 'test' AS split, label, t AS n FROM pl UNION ALL SELECT 'train', label, c - t FROM pl)""",
       final=f"""SELECT split, CAST(sum(n) AS BIGINT) AS n, {r6('sum(n * label) / sum(n)', 'fake_share')} FROM pm
         GROUP BY split""")
oracle("m6_confusion", *SC, JU, final="SELECT label, predicted, count(*) AS n FROM ju GROUP BY label, predicted")
_M7 = """(SELECT label, p FROM sc)""", """(SELECT label, (sentiment + 1) / 2 AS p FROM sc)"""
oracle("m7_comparison", *SC, final=" UNION ALL ".join(
    f"""SELECT {q(n)} AS model, (SELECT {r6('avg(CASE WHEN (p >= 0.5) = (label = 1) THEN 1 ELSE 0 END)', 'a')} FROM {t})
      AS accuracy, (SELECT {r6('''2 * sum(CASE WHEN p >= 0.5 AND label = 1 THEN 1 ELSE 0 END)
      / (sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) + sum(label))''', 'f')} FROM {t}) AS f1,
      {r6(AUC.format(t), 'auc')} FROM {COUNTS.format(t)}""" for n, t in zip(("linear", "sentiment"), _M7)))

# --------------------------------------------------------------------------- digest
def candidates(source: str, out: str = "ca") -> list[str]:
    stripped = STRIP.format("text")
    return [f"{out}_f AS (SELECT product_id, review_id, {stripped} AS text FROM {source} WHERE {stripped} <> '')",
            sentences(out + "_f", out + "_s"),
            f"""{out} AS (SELECT * FROM {out}_s
              WHERE len(regexp_extract_all(sentence, {WORD})) BETWEEN {lx.DIGEST_MIN_WORDS} AND {lx.DIGEST_MAX_WORDS})"""]


def vectors(source: str = "ca", column: str = "sentence", out: str = "ve") -> list[str]:
    """``out(product_id, nid, term, w)``; ``out_id`` numbers the texts of a product in order."""
    return [
        f"""{out}_id AS (SELECT product_id, review_id, sent_no, {column} AS body,
          row_number() OVER (ORDER BY product_id, review_id, sent_no) AS nid, count(*) OVER (PARTITION BY product_id) AS n
          FROM {source})""",
        f"""{out}_t AS (SELECT product_id, nid, n, term, count(*) AS k FROM (SELECT product_id, nid, n,
          unnest(regexp_extract_all(lower(body), {q(lx.DIGEST_TOKEN)})) AS term FROM {out}_id)
          WHERE term NOT IN {among(lx.DIGEST_STOPWORDS)} GROUP BY ALL)""",
        f"""{out}_w AS (SELECT product_id, nid, term, (1 + ln(k)) * (ln((1 + n) / (1 + count(*) OVER
          (PARTITION BY product_id, term))) + 1) AS w FROM {out}_t)""",
        f"""{out} AS MATERIALIZED (SELECT product_id, nid, term, w / sqrt(sum(w * w) OVER (PARTITION BY nid)) AS w
          FROM {out}_w)""",
        f"""{out}_g AS MATERIALIZED (SELECT a.product_id, a.nid AS src, b.nid AS dst, sum(a.w * b.w) AS sim
          FROM {out} a JOIN {out} b ON a.product_id = b.product_id AND a.term = b.term AND a.nid <> b.nid GROUP BY ALL)""",
        f"{out}_r AS MATERIALIZED (SELECT src, sum(sim) AS rs FROM {out}_g GROUP BY src)",
    ]


def ranks(out: str = "ra", v: str = "ve") -> list[str]:
    """``out(product_id, nid, r)``: power iteration over the explicit graph, each product until it settles."""
    return [
        f"""{out}_e AS MATERIALIZED (SELECT src, dst, sim / rs AS p FROM {v}_g JOIN {v}_r USING (src) UNION ALL
          SELECT a.nid, b.nid, 1.0 / a.n FROM {v}_id a JOIN {v}_id b USING (product_id)
          WHERE a.nid NOT IN (SELECT src FROM {v}_r))""",
        f"""{out}_i AS (SELECT 0 AS it, product_id, nid, n, CAST(1.0 / n AS DOUBLE) AS r, false AS done FROM {v}_id
          WHERE n > 1 UNION ALL
          SELECT it, product_id, nid, n, CASE WHEN d < 1e-8 THEN r ELSE m END AS r, d < 1e-8 AS done FROM (
            SELECT *, sum(abs(m - r)) OVER (PARTITION BY product_id) AS d FROM (
              SELECT c.it + 1 AS it, c.product_id, c.nid, c.n, c.r, 0.15 / c.n + 0.85 * coalesce(x.s, 0) AS m
              FROM {out}_i c LEFT JOIN (SELECT e.dst, sum(e.p * k.r) AS s FROM {out}_i k JOIN {out}_e e ON e.src = k.nid
                WHERE NOT k.done GROUP BY e.dst) x ON x.dst = c.nid
              WHERE NOT c.done AND c.it < 100)))""",
        f"""{out}_l AS (SELECT product_id, nid, arg_max(r, it) AS r FROM {out}_i GROUP BY product_id, nid)""",
        f"""{out} AS MATERIALIZED (SELECT product_id, review_id, sent_no, nid, body, n, CASE WHEN n < 2
          OR product_id NOT IN (SELECT product_id FROM {v}) THEN 1.0 ELSE r END AS r
          FROM {v}_id LEFT JOIN {out}_l USING (product_id, nid))""",
    ]


def linked(v: str = "ve") -> list[str]:
    """``v_l``: entries whose term another text of the product has; ``v_r``: similarity sums from sums per term."""
    return [
        f"{v}_l AS MATERIALIZED (SELECT * FROM {v} QUALIFY count(*) OVER (PARTITION BY product_id, term) > 1)",
        f"""{v}_r AS MATERIALIZED (SELECT nid AS src, sum(w * (total - w)) AS rs FROM (SELECT *, sum(w) OVER
          (PARTITION BY product_id, term) AS total FROM {v}_l) GROUP BY nid)""",
    ]


def ranks_by_terms(out: str = "ra", v: str = "ve") -> list[str]:
    """As ``ranks``, without the graph: for products with many texts."""
    weight = "e.w * k.r / k.rs"
    entries = f"FROM {out}_i k JOIN {v}_l e ON e.nid = k.nid"
    return linked(v) + [
        f"""{out}_i AS (SELECT 0 AS it, product_id, nid, n, rs, CAST(1.0 / n AS DOUBLE) AS r, false AS done FROM {v}_id
          LEFT JOIN {v}_r ON src = nid WHERE n > 1 UNION ALL
          SELECT it, product_id, nid, n, rs, CASE WHEN d < 1e-8 THEN r ELSE m END AS r, d < 1e-8 AS done FROM (
            SELECT *, sum(abs(m - r)) OVER (PARTITION BY product_id) AS d FROM (
              SELECT c.it + 1 AS it, c.product_id, c.nid, c.n, c.rs, c.r,
                0.15 / c.n + 0.85 * (coalesce(x.s, 0) + coalesce(z.l, 0) / c.n) AS m
              FROM {out}_i c LEFT JOIN (SELECT e.nid, sum(e.w * (t.q - {weight})) AS s {entries}
                JOIN (SELECT e.product_id, e.term, sum({weight}) AS q {entries} WHERE NOT k.done
                  GROUP BY e.product_id, e.term) t ON t.product_id = e.product_id AND t.term = e.term
                WHERE NOT k.done GROUP BY e.nid) x ON x.nid = c.nid
              LEFT JOIN (SELECT product_id, sum(r) AS l FROM {out}_i WHERE rs IS NULL AND NOT done GROUP BY product_id) z
                ON z.product_id = c.product_id
              WHERE NOT c.done AND c.it < 100)))""",
        *ranks(out, v)[2:],
    ]


def picks(out: str = "mm", v: str = "ve", rank: str = "ra", k: int = lx.DIGEST_SENTENCES, graph: bool = True) -> list[str]:
    """``out(nid, pick)`` by greedy rounds; without the graph, similarities to the picks from their terms."""
    steps = [f"""{out}_s AS MATERIALIZED (SELECT product_id, nid, r / max(r) OVER (PARTITION BY product_id) AS s FROM {rank}
      WHERE n > 1 AND product_id IN (SELECT product_id FROM {v}))""",
             f"{out}_0 AS (SELECT CAST(0 AS BIGINT) AS nid, 0 AS pick WHERE false)"]
    near = f"{v}_g WHERE dst IN {{0}}" if graph else (
        f"(SELECT a.nid AS src, b.nid AS dst, sum(a.w * b.w) AS sim FROM {v}_l a JOIN {v}_l b ON a.product_id = b.product_id "
        f"AND a.term = b.term AND a.nid <> b.nid WHERE b.nid IN {{0}} GROUP BY ALL)")
    for i in range(1, k + 1):
        steps.append(f"""{out}_{i} AS MATERIALIZED (SELECT * FROM {out}_{i - 1} UNION ALL SELECT nid, {i} FROM (
          SELECT a.product_id, a.nid, row_number() OVER (PARTITION BY a.product_id ORDER BY
            round(0.7 * s - 0.3 * coalesce(x.m, 0), 9) DESC, a.nid) AS k
          FROM {out}_s a LEFT JOIN (SELECT src, max(sim) AS m FROM {near.format(f"(SELECT nid FROM {out}_{i - 1})")}
            GROUP BY src) x ON x.src = a.nid WHERE a.nid NOT IN (SELECT nid FROM {out}_{i - 1})) WHERE k = 1)""")
    return steps + [f"{out} AS (SELECT * FROM {out}_{k})"]


KEPT = "kp AS (SELECT * FROM ro WHERE label = 0)"
ND = "product_id, review_id, sent_no"
oracle("g1_candidates", RO, KEPT, *candidates("kp"), final="SELECT * FROM ca")
oracle("g2_product_tfidf", RO, KEPT, *candidates("kp"), *vectors(),
       final=f"SELECT ve_id.product_id, review_id, sent_no, term, {r6('w')} FROM ve JOIN ve_id USING (nid)")
oracle("g3_similarity", RO, KEPT, *candidates("kp"), *vectors(),
       final=f"SELECT {ND}, {r6('coalesce(rs, 0)', 'sim_sum')} FROM ve_id LEFT JOIN ve_r ON src = nid")
MANY = [*candidates("rd"), *vectors()[:4]]  # texts of large products, without their graph
oracle("g3_similarity_docs", RD, *MANY, *linked(),
       final=f"SELECT {ND}, {r6('coalesce(rs, 0)', 'sim_sum')} FROM ve_id LEFT JOIN ve_r ON src = nid")
# texts with the same terms and counts are one node, the smallest of them
CLASSES = [*MANY, """cl AS MATERIALIZED (SELECT product_id, nid, min(nid) OVER (PARTITION BY product_id, bag) AS rep,
  count(*) OVER (PARTITION BY product_id, bag) AS copies FROM (SELECT product_id, nid,
  list((term, k) ORDER BY term) AS bag FROM ve_t GROUP BY ALL))"""]
oracle("g3_classes", RD, *CLASSES,
       final="""SELECT i.product_id, i.review_id, i.sent_no, r.review_id AS rep_review_id, r.sent_no AS rep_sent_no
         FROM cl JOIN ve_id i USING (nid) JOIN ve_id r ON r.nid = rep""")
oracle("g3_edges", RD, *CLASSES,
       """cv AS MATERIALIZED (SELECT ve.product_id, ve.nid, term, w FROM ve JOIN cl USING (nid) WHERE cl.nid = rep)""",
       """ce AS (SELECT a.nid AS src, b.nid AS dst, sum(a.w * b.w) AS sim FROM cv a JOIN cv b ON a.product_id = b.product_id
         AND a.term = b.term AND a.nid < b.nid GROUP BY ALL HAVING round(sum(a.w * b.w), 9) >= 0.5)""",
       final=f"""SELECT a.product_id, a.review_id, a.sent_no, ca.copies, b.review_id AS other_review_id,
         b.sent_no AS other_sent_no, cb.copies AS other_copies, {r6('sim')} FROM ce JOIN ve_id a ON a.nid = src
         JOIN ve_id b ON b.nid = dst JOIN cl ca ON ca.nid = src JOIN cl cb ON cb.nid = dst""")
oracle("g4_rank_docs", RD, *MANY, *ranks_by_terms(), *picks(graph=False), recursive=True,
       final=f"SELECT {ND}, {r6('r', 'centrality')}, coalesce(pick, 0) AS pick FROM ra LEFT JOIN mm USING (nid)")
oracle("g5_mmr_docs", RD, *MANY, *ranks_by_terms(), *picks(graph=False), recursive=True,
       final=f"SELECT {ND}, pick FROM mm JOIN ra USING (nid)")
oracle("g4_rank", RO, KEPT, *candidates("kp"), *vectors(), *ranks(), recursive=True,
       final=f"SELECT {ND}, {r6('r', 'centrality')} FROM ra")
oracle("g5_mmr", RO, KEPT, *candidates("kp"), *vectors(), *ranks(), *picks(), recursive=True,
       final=f"SELECT {ND}, pick FROM mm JOIN ra USING (nid)")


def digest(source: str, products: str) -> list[str]:
    return candidates(source) + vectors() + ranks() + picks() + [
        """dx AS (SELECT product_id, string_agg(body, ' ' ORDER BY pick) AS x FROM mm JOIN ra USING (nid)
          GROUP BY product_id)""",
        f"""df AS (SELECT product_id, string_agg(sentence, ' ' ORDER BY review_id, sent_no) AS f FROM (SELECT *,
          row_number() OVER (PARTITION BY product_id ORDER BY review_id, sent_no) AS k FROM ca)
          WHERE k <= {lx.DIGEST_SENTENCES} GROUP BY product_id)""",
        f"""dw AS (SELECT product_id, substr(string_agg(text, ' ' ORDER BY review_id), 1, {lx.DIGEST_FALLBACK_CHARS}) AS w,
          count(*) AS k FROM ca_f GROUP BY product_id)""",
        f"""dg AS (SELECT product_id, coalesce(x, f, w, {q(lx.DIGEST_EMPTY)}) AS summary, 'extractive' AS backend,
          coalesce(k, 0) AS n_reviews FROM {products} LEFT JOIN dx USING (product_id) LEFT JOIN df USING (product_id)
          LEFT JOIN dw USING (product_id))""",
    ]


oracle("g7_digest", RO, KEPT, *digest("kp", "(SELECT DISTINCT product_id FROM ro)"), recursive=True,
       final="SELECT * FROM dg")
oracle("g7_digest_turns", RT, *digest("rt", "(SELECT DISTINCT product_id FROM rt)"), recursive=True,
       final="SELECT * FROM dg")
def filled(source: str) -> str:
    return (f"fl AS (SELECT product_id, review_id, 0 AS sent_no, {STRIP.format('text')} AS text FROM {source} "
            f"WHERE {STRIP.format('text')} <> '')")


PACKED = [
    f"""od AS (SELECT product_id, review_id, len(regexp_extract_all(body, {WORD})) AS n_words, row_number() OVER
      (PARTITION BY product_id ORDER BY round(r, 9) DESC, review_id) AS o FROM ra)""",
    f"""pa AS (SELECT product_id, 0 AS o, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS filled, 0 AS chunk_no,
      false AS taken FROM od GROUP BY product_id UNION ALL
      SELECT p.product_id, p.o + 1, CASE WHEN fits THEN used + n_words ELSE used END,
        CASE WHEN NOT fits THEN filled WHEN opens THEN n_words ELSE filled + n_words END,
        CASE WHEN fits AND opens THEN chunk_no + 1 ELSE chunk_no END, fits
      FROM (SELECT p.*, od.n_words, used + od.n_words <= {lx.CHUNK_WORDS * lx.MAX_CHUNKS} AS fits,
        chunk_no = 0 OR filled + od.n_words > {lx.CHUNK_WORDS} AS opens
        FROM pa p JOIN od ON od.product_id = p.product_id AND od.o = p.o + 1) p)""",
]
PACK = [filled("kp"), *vectors("fl", "text"), *ranks(), *PACKED]
PACK_DOCS = [filled("rd"), *vectors("fl", "text")[:4], *ranks_by_terms(), *PACKED]
CHUNKS = "SELECT product_id, review_id, chunk_no, n_words FROM pa JOIN od USING (product_id, o) WHERE taken"
oracle("g8_pack", RO, KEPT, *PACK, recursive=True,
       final=CHUNKS)
oracle("g8_pack_docs", RD, *PACK_DOCS, recursive=True, final=CHUNKS.replace("n_words FROM", "CAST(n_words AS INT) AS n_words FROM"))


def first_words(text: str, n: str) -> str:
    """The stand-in for a generation model: as many words as it may write."""
    return (f"array_to_string(regexp_extract_all({text}, '\\S+')[1:CAST(floor(least(160, greatest(40, {n} * 0.6::DOUBLE))) "
            "AS INT)], ' ')")


TWO_LEVEL = [
    """ct AS (SELECT product_id, chunk_no, sum(n_words) AS nw, string_agg(text, ' ' ORDER BY o) AS t FROM pa
      JOIN od USING (product_id, o) JOIN fl USING (product_id, review_id) WHERE taken GROUP BY product_id, chunk_no)""",
    f"""cj AS (SELECT product_id, count(*) AS n_chunks, string_agg({first_words('t', 'nw')}, ' ' ORDER BY chunk_no) AS t
      FROM ct GROUP BY product_id)""",
    f"""tl AS (SELECT product_id, n_chunks, CASE WHEN n_chunks = 1 THEN t
      ELSE {first_words('t', f'len(regexp_extract_all(t, {WORD}))')} END AS summary FROM cj)""",
]
oracle("g10_two_level", RD, *PACK_DOCS, *TWO_LEVEL, recursive=True, final="SELECT product_id, summary, n_chunks FROM tl")
oracle("g9_bounds", final=f"""SELECT review_id, CAST(mx AS INT) AS max_len,
  CAST(floor(least(mx - 10, greatest(15, n * 0.15::DOUBLE))) AS INT) AS min_len FROM (SELECT review_id, n,
  floor(least(160, greatest(40, n * 0.6::DOUBLE))) AS mx FROM (SELECT doc_id AS review_id,
  len(regexp_extract_all(text, {WORD})) AS n FROM documents))""")

# --------------------------------------------------------------------------- aspects
KNOWN = [t for terms in lx.ASPECTS.values() for t in terms]


def discovery(source: str, out: str = "di") -> list[str]:
    return [
        f"""{out}_t AS (SELECT DISTINCT product_id, review_id, lower(term) AS term FROM (SELECT product_id, review_id,
          unnest(regexp_extract_all(text, {q('(?i)' + lx.ASPECT_STATEMENT)}, 1)) AS term FROM {source}))""",
        f"""{out}_c AS (SELECT product_id, term, count(*) AS n FROM {out}_t WHERE term NOT IN {among(KNOWN)}
          AND string_split(term, ' ')[1] NOT IN {among(lx.GENERIC_NOUNS)}
          AND string_split(term, ' ')[-1] NOT IN {among(lx.GENERIC_NOUNS)}
          AND len(list_filter(string_split(term, ' '), lambda w: w IN {among(KNOWN)})) = 0
          GROUP BY product_id, term HAVING count(*) >= {lx.MIN_MENTIONS})""",
        f"""{out} AS (SELECT *, CAST(row_number() OVER (PARTITION BY product_id ORDER BY n DESC, term) AS INT) AS rank FROM {out}_c
          QUALIFY rank <= {lx.MAX_DISCOVERED})""",
    ]


def _pattern(terms) -> str:
    escaped = sorted((t.replace("-", r"\-") for t in terms), key=len, reverse=True)
    return q(r"(?i)\b(?:" + "|".join(escaped) + r")(?:s|es)?\b")


CK = "product_id, review_id, sent_no, clause_no, clause"


def mentions(source: str, discover: bool = True, out: str = "me") -> list[str]:
    hits = [spans("cl", CK, "clause", _pattern(terms), f", {q(a)} AS aspect, false AS discovered")
            for a, terms in lx.ASPECTS.items()]
    if discover:
        pattern = r"'(?i)\b(?:' || term || ')(?:s|es)?\b'"
        hits.append(spans("(SELECT cl.*, term FROM cl JOIN di USING (product_id) WHERE contains(lower(clause), term))",
                          CK + ", term", "clause", pattern,
                          ", upper(term[1]) || term[2:] AS aspect, true AS discovered").replace(
            f"SELECT {CK}, term, b", f"SELECT {CK}, b", 1))
    return (discovery(source) if discover else []) + [
        sentences(source), clauses(),
        f"{out}_h AS MATERIALIZED (" + " UNION ALL ".join(hits) + ")",
        f"""{out}_k AS (SELECT * FROM {out}_h h WHERE NOT EXISTS (SELECT 1 FROM {out}_h o WHERE
          o.product_id = h.product_id AND o.review_id = h.review_id AND o.sent_no = h.sent_no
          AND o.clause_no = h.clause_no AND o.b <= h.b AND h.e <= o.e AND o.e - o.b > h.e - h.b))""",
        f"""{out} AS (SELECT {CK}, CAST(b AS INT) AS "start", aspect, hit AS term, discovered FROM {out}_k QUALIFY row_number() OVER
          (PARTITION BY product_id, review_id, sent_no, clause_no, aspect ORDER BY b, e) = 1)""",
    ]


def opinions(out: str = "op") -> list[str]:
    """``op``: mentions with span and score; sentiment of clauses and segments by distinct text."""
    return [
        segments(),
        f"""{out}_s AS (SELECT m.*, g.segment FROM (SELECT *, row_number() OVER () AS mid FROM me) m
          LEFT JOIN sg g ON g.product_id = m.product_id AND g.review_id = m.review_id AND g.sent_no = m.sent_no
          AND g.clause_no = m.clause_no AND contains(lower(g.segment), lower(m.term))
          QUALIFY row_number() OVER (PARTITION BY mid ORDER BY seg_no) = 1)""",
        f"""{out}_x AS MATERIALIZED (SELECT text, row_number() OVER () AS id FROM (SELECT clause AS text FROM {out}_s UNION
          SELECT segment FROM {out}_s WHERE segment IS NOT NULL))""",
        *sentiment(out + "_x", out + "_n"),
        f"{out}_y AS MATERIALIZED (SELECT text, s FROM {out}_x JOIN {out}_n USING (id))",
        f"""{out} AS (SELECT m.*, CASE WHEN abs(a.s) > 0.05 THEN segment ELSE clause END AS span,
          CASE WHEN abs(a.s) > 0.05 THEN a.s ELSE c.s END AS score FROM {out}_s m LEFT JOIN {out}_y a ON a.text = m.segment
          JOIN {out}_y c ON c.text = m.clause)""",
        f"""vt AS (SELECT product_id, aspect, review_id, discovered, avg(score) AS vote FROM {out}
          GROUP BY product_id, aspect, review_id, discovered)""",
        """ag AS (SELECT product_id, aspect, count(*) AS mentions, count(*) FILTER (vote > 0.1) AS positive,
          count(*) FILTER (abs(vote) <= 0.1) AS neutral, count(*) FILTER (vote < -0.1) AS negative, avg(vote) AS score,
          bool_or(discovered) AS discovered FROM vt GROUP BY product_id, aspect HAVING count(*) >= 2)""",
        "ar AS (SELECT *, CASE " + " ".join(f"WHEN score >= {v} THEN {q(n)}" for v, n in lx.VERDICTS)
        + f" ELSE {q(lx.WORST_VERDICT)} END AS verdict FROM ag)",
    ]


POS = 'review_id, sent_no, clause_no, "start"'
ASPECTS = [RO, KEPT, *mentions("kp"), *opinions()]
oracle("a1_aspect_terms", RO, *mentions("ro", discover=False),
       final="SELECT aspect, lower(term) AS term, count(*) AS n FROM me GROUP BY aspect, lower(term)")
oracle("a2_discovery", RO, KEPT, *discovery("kp"), final="SELECT product_id, term, n, rank FROM di")
oracle("a4_a6_mentions", RO, KEPT, *mentions("kp"), final="SELECT * FROM me")
oracle("a7_span", *ASPECTS, final=f"SELECT product_id, {POS}, aspect, span, {r6('score')} FROM op")
oracle("a9_votes", *ASPECTS, final=f"SELECT product_id, aspect, review_id, discovered, {r6('vote')} FROM vt")
AR = f"product_id, aspect, mentions, positive, neutral, negative, {r6('score')}, discovered, verdict"
oracle("a10_aspects", *ASPECTS, final=f"SELECT {AR} FROM ar")
oracle("a10_aspects_turns", RT, *mentions("rt"), *opinions(), final=f"SELECT {AR} FROM ar")
oracle("a13_examples", *ASPECTS,
       f"""ex AS (SELECT product_id, aspect, span, score, {POS}, CASE WHEN score > 0.1 THEN 0 WHEN score < -0.1 THEN 1
         ELSE 2 END AS side FROM op JOIN ar USING (product_id, aspect) """.replace("score,", "op.score,", 1)
       .replace("WHEN score", "WHEN op.score") + ")",
       f"""ey AS (SELECT *, row_number() OVER (PARTITION BY product_id, aspect, side ORDER BY abs(score) DESC, {POS}) AS k,
         min(side) OVER (PARTITION BY product_id, aspect) AS first FROM ex)""",
       """ez AS (SELECT product_id, aspect, CAST(row_number() OVER (PARTITION BY product_id, aspect ORDER BY side, k) AS INT) AS rank,
         span AS snippet, score FROM ey WHERE CASE side WHEN 2 THEN first = 2 AND k <= 3 ELSE k <= 2 END)""",
       final=f"SELECT product_id, aspect, rank, snippet, {r6('score')} FROM ez WHERE rank <= 3")
oracle("a8_pair_scores", RO, KEPT, *mentions("kp"),
       final=f"""SELECT m.product_id, m.review_id, m.sent_no, m.clause_no, "start", aspect,
         CASE WHEN strpos(sentence, term) BETWEEN 1 AND 10 OR strpos(sentence, term) = 0 THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END AS score
         FROM me m JOIN se USING (product_id, review_id, sent_no)""")

# --------------------------------------------------------------------------- report
oracle("p1_flag", *SC, final="SELECT product_id, review_id, p >= 0.5 AS is_fake FROM sc")
oracle("p2_genuine", *SC, final="SELECT product_id, review_id, text FROM sc WHERE p < 0.5")
oracle("p4_suspicion", *SC, final=f"""SELECT product_id, review_id, {r6('p', 'fake_prob')} FROM sc WHERE p >= 0.5
  ORDER BY p DESC, review_id""")
oracle("p5_reviews", *SC, *PHRASES, *REASONS,
       "pj AS (SELECT review_id, string_agg(phrase, ', ' ORDER BY rank) AS ps FROM ph GROUP BY review_id)",
       "rj AS (SELECT review_id, string_agg(reason, '; ' ORDER BY rank) AS rs FROM re GROUP BY review_id)",
       final="""SELECT product_id, review_id, text, rating, round(p, 3) AS fake_prob,
         CASE WHEN p >= 0.5 THEN 'Fake' ELSE 'Genuine' END AS verdict, coalesce(ps, '') AS suspicious_phrases,
         coalesce(rs, '') AS reasons FROM sc LEFT JOIN pj USING (review_id) LEFT JOIN rj USING (review_id)""")
oracle("p3_view", *SC, final="""SELECT 'All' AS shown, product_id, review_id FROM sc UNION ALL
  SELECT 'Flagged', product_id, review_id FROM sc WHERE p >= 0.5 UNION ALL
  SELECT 'Genuine', product_id, review_id FROM sc WHERE p < 0.5""")
oracle("p5_highlighted", *SC, *PHRASES, *REASONS,
       "rj AS (SELECT review_id, string_agg(reason, '; ' ORDER BY rank) AS rs FROM re GROUP BY review_id)",
       "sp AS (SELECT DISTINCT review_id, b, e FROM (" + spans(
           "(SELECT review_id, phrase, text FROM ph JOIN sc USING (review_id) WHERE p >= 0.5)", "review_id, phrase", "text",
           r"'(?i)\b' || replace(phrase, ' ', '\W+') || '\b'") + "))",
       *MERGED, *MARKED, final=f"""SELECT product_id, review_id, p >= 0.5 AS is_fake, {MARKUP} AS body,
         CASE WHEN p >= 0.5 THEN coalesce(rs, '') ELSE '' END AS why
         FROM sc LEFT JOIN pj USING (review_id) LEFT JOIN rj USING (review_id)""")
A6 = """product_id, aspect, verdict, round(score, 2) + 0.0 AS score, mentions, positive, neutral, negative, discovered"""
oracle("p6_aspects", *ASPECTS, final=f"SELECT {A6} FROM ar")
oracle("r8_aspect_chart", *ASPECTS, final=f"SELECT {A6} FROM ar ORDER BY product_id, score DESC, aspect")


def stats(source: str, threshold: str, group: str) -> str:
    ok = f"p < {threshold}"
    return f"""SELECT {group}, count(*) AS n_total, count(*) FILTER (p >= {threshold}) AS n_fake,
      {r6(f'avg(CASE WHEN p >= {threshold} THEN 1 ELSE 0 END)', 'pct_fake')}, {r6('avg(rating)', 'raw_avg_rating')},
      {r6(f'avg(rating) FILTER ({ok})', 'genuine_avg_rating')},
      {r6(f'coalesce(avg(CASE WHEN sentiment > 0.1 THEN 1 ELSE 0 END) FILTER ({ok}), 0)', 'genuine_positive')},
      {r6(f'coalesce(avg(CASE WHEN sentiment < -0.1 THEN 1 ELSE 0 END) FILTER ({ok}), 0)', 'genuine_negative')},
      {r6(f'avg(rating) FILTER ({ok}) - avg(rating)', 'rating_shift')} FROM {source} GROUP BY {group}"""


oracle("r1_r4_stats", *SC, final=stats("sc", "0.5", "product_id"))
oracle("r6_threshold_grid", *SC,
       "gr AS (SELECT sc.*, CAST(i * 0.05 AS DOUBLE) AS threshold FROM sc, (SELECT unnest(range(1, 20)) AS i))",
       final=stats("gr", "threshold", "product_id, threshold"))
for name, threshold in [("r5_rethreshold", "0.7"), ("r7_report", "0.5")]:
    oracle(name, *SC, "rs AS (" + stats("sc", threshold, "product_id") + ")", f"kp AS (SELECT * FROM sc WHERE p < {threshold})",
           *digest("kp", "(SELECT DISTINCT product_id FROM sc)"),
           *mentions("kp"), *opinions(),
           """vd AS (SELECT product_id, string_agg(aspect || ': ' || verdict, '; ' ORDER BY mentions DESC, aspect) AS verdicts
             FROM ar GROUP BY product_id)""", recursive=True,
           final="""SELECT product_id, n_total, n_fake, pct_fake, raw_avg_rating, genuine_avg_rating, genuine_positive,
             genuine_negative, rating_shift, summary, n_reviews, coalesce(verdicts, '') AS verdicts
             FROM rs JOIN dg USING (product_id) LEFT JOIN vd USING (product_id)""")
oracle("r7_report_generated", *SC, "kp AS (SELECT * FROM sc WHERE p < 0.5)", *PACK, *TWO_LEVEL,
       "nr AS (SELECT product_id, count(*) AS k FROM fl GROUP BY product_id)", recursive=True,
       final=f"""SELECT product_id, coalesce(summary, {q(lx.DIGEST_EMPTY)}) AS summary, 'abstractive' AS backend,
         coalesce(k, 0) AS n_reviews FROM (SELECT DISTINCT product_id FROM sc) LEFT JOIN tl USING (product_id)
         LEFT JOIN nr USING (product_id)""")

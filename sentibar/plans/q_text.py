"""Registered queries: text cleaning, extraction, prompts and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as FV
from ..functions import text as TX
from ..operators import pages as PG
from ..operators import scoring as SC
from ..functions.times import parse_time
from ..sources import fixtures as FX
from ..sources.tables import spread
from .catalog import register
from .oracle import clean_html_sql, cte, q, strip_sql


def news(t):
    return FX.news_from_orders(t.orders)


def _section_sql(h: str, tag: str) -> str:
    return f"regexp_extract({h}, {q(rf'(?is)<{tag}\b[^>]*>(.*?)</{tag}>')}, 1)"


# The test pages carry none of the field classes, so the twins state the
# stand-ins; class selectors have inline pages in tests/test_pages.py.
_ART = _section_sql("h", "article")
_LEAD = f"regexp_extract({_ART}, {q(r'(?is)<b\b[^>]*>(.*?)(?:<br|</b>|<p\b)')}, 1)"
_FOOTER = clean_html_sql(_section_sql("h", "footer"))
_PROVIDER = (f"regexp_replace({strip_sql(f'split_part({_FOOTER}, {q(chr(183))}, 1)')}, "
             f"{q(r'^©\s*|^,\s*')}, '', 'g')")
_NAV = (f"list_filter(list_transform(regexp_extract_all({_section_sql('h', 'nav')}, "
        f"{q(r'(?is)<a\b[^>]*>(.*?)</a>')}, 1), lambda x: {clean_html_sql('x')}), "
        f"lambda x: length(x) > 0)")
_PARAS = (f"list_filter(list_transform(regexp_split_to_array({_ART}, {q(r'<p\b[^>]*>')})[2:], "
          f"lambda x: {clean_html_sql("split_part(x, '</p>', 1)")}), lambda x: length(x) > 0)")

cte("page_clean", """  SELECT page_id, url,
         regexp_replace(html, '(?is)<div class="(?:ad|syndigate_disclaimer|footnote-disclaimer)"[^>]*>.*?</div>', ' ', 'g') AS h
  FROM pages""")
cte("page_record", f"""  SELECT page_id, coalesce(nullif({clean_html_sql(_section_sql('h', 'h1'))}, ''), '') AS title,
       coalesce({clean_html_sql(_LEAD)}, '') AS lead,
       regexp_extract(h, {q(r'<html\b[^>]*\blang="([^"]*)"')}, 1) AS category,
       '' AS date, '' AS author,
       coalesce({_PROVIDER}, '') AS provider,
       coalesce(array_to_string({_NAV}, '|'), '') AS tags,
       array_to_string({_PARAS}, chr(10) || chr(10)) AS body,
       coalesce(url, '') AS url
  FROM page_clean""", "page_clean")


@register("clean_html", ops="B5 B24",
          sql=f"SELECT page_id, {clean_html_sql('html')} AS text, "
              f"length({clean_html_sql('html')}) AS n_chars FROM pages", dates=())
def q_clean_html(t):
    txt = spread(t.pages).select("page_id", TX.clean_html("html").alias("text"))
    return txt.withColumn("n_chars", F.length("text").cast("long"))


@register("page_fields", ops="A17 B22 B23", sql="SELECT * FROM page_record",
          ctes=("page_record",), dates=())
def q_page_fields(t):
    return PG.page_fields(spread(t.pages))


@register("page_links", ops="A18 G2",
          sql=f"""SELECT DISTINCT page_id, href FROM (
  SELECT page_id, regexp_extract(a, 'href="([^"]*)"', 1) AS href,
         {clean_html_sql(f"regexp_extract(a, {q(r'(?is)>(.*?)</a>')}, 1)")} AS label
  FROM (SELECT page_id, unnest(regexp_extract_all(html, {q(r'(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>')}, 0)) AS a
        FROM pages)) WHERE length(href) > 0 AND length(label) > 0""", dates=())
def q_page_links(t):
    return PG.page_links(spread(t.pages))


@register("tags_flatten", ops="B22",
          sql=f"SELECT page_id, coalesce(array_to_string({_NAV}, '|'), '') AS tags, "
              f"len({_NAV}) AS n_tags FROM page_clean", ctes=("page_clean",), dates=())
def q_tags(t):
    labels = F.regexp_extract_all(F.regexp_extract("html", r"(?is)<nav\b[^>]*>(.*?)</nav>", 1),
                                  F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), 1)
    nav = F.filter(F.transform(labels, lambda x: TX.clean_html(x)), lambda x: F.length(x) > 0)
    return spread(t.pages).select("page_id", TX.tags_flatten(nav).alias("tags"),
                                  F.size(nav).cast("long").alias("n_tags"))


_REPLY_J = "regexp_extract(reply, '(?s)\\{.*\\}')"


@register("llm_reply_json", ops="B11",
          sql=f"""SELECT news_id,
       CASE WHEN json_valid(j) THEN json_extract_string(j, '$.asset') END AS asset,
       CASE WHEN json_valid(j) THEN json_extract_string(j, '$.reasoning') END AS reasoning,
       CASE WHEN json_valid(j) THEN json_extract_string(j, '$.impact_type') END AS impact_type,
       CASE WHEN json_valid(j) THEN TRY_CAST(json_extract(j, '$.sentiment_score') AS DOUBLE) END AS sentiment_score,
       CASE WHEN json_valid(j) THEN TRY_CAST(json_extract(j, '$.confidence_score') AS DOUBLE) END AS confidence_score
FROM (SELECT news_id, {_REPLY_J} AS j FROM replies)""",
          ctes=("replies",), rnd=("sentiment_score", "confidence_score"), dates=())
def q_llm_reply(t):
    rep = FX.reply_text_from_orders(spread(t.orders)).select("news_id", "reply")
    return SC.with_reply_fields(rep, "reply").drop("reply")


def _asset_name():
    return (F.when(F.col("news_id") % 13 == 0, F.lit("XAU"))
            .otherwise(F.create_map(*[F.lit(x) for kv in FX.ASSET_NAMES.items() for x in kv])
                       [F.col("asset_tag")]))


_ASSET_NAME_SQL = ("CASE WHEN news_id % 13 = 0 THEN 'XAU' ELSE CASE asset_tag "
                   + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in FX.ASSET_NAMES.items())
                   + " END END")
_LONG_INNER = ("coalesce(nullif(summary, ''), nullif(headline, ''), '') || chr(10) || chr(10) "
               "|| coalesce(nullif(content, ''), '')")
_LONG_SQL = strip_sql(_LONG_INNER)


def _prompt_sql(asset: str, text: str) -> str:
    whens = []
    for needles, tpl in FV.PROMPT_CASCADE:
        cond = " OR ".join(f"contains({asset}, {q(n)})" for n in needles)
        whens.append(f"WHEN {cond} THEN {q(tpl)}")
    return (f"(CASE {' '.join(whens)} ELSE {q(FV.PROMPT_FALLBACK)} END) || "
            f"{q(FV.PROMPT_INPUT_SEPARATOR)} || {text}")


@register("prompt_render", ops="B9 B10",
          sql=f"""SELECT news_id, asset, length(p) AS prompt_len, md5(p) AS prompt_md5 FROM (
  SELECT news_id, {_ASSET_NAME_SQL} AS asset,
         {_prompt_sql(_ASSET_NAME_SQL, _LONG_SQL)} AS p FROM news)""",
          ctes=("news",), dates=())
def q_prompt(t):
    n = FX.news_from_orders(spread(t.orders)).withColumn("asset", _asset_name())
    p = TX.render_prompt("asset", TX.long_scorer_text("summary", "headline", "content"))
    return n.select("news_id", "asset", F.length(p).cast("long").alias("prompt_len"),
                    F.md5(p).alias("prompt_md5"))


@register("scorer_text", ops="B1 B8 B9",
          sql=f"""SELECT doc_id, nullif(headline, '') AS short_text,
       length(lt) AS long_len, md5(lt) AS long_md5, length(st) AS retry_len
FROM (SELECT doc_id, headline,
             {strip_sql("coalesce(nullif(headline, ''), '') || chr(10) || chr(10) || coalesce(nullif(text, ''), '')")} AS lt,
             substring({strip_sql("coalesce(nullif(headline, ''), '') || chr(10) || chr(10) || coalesce(nullif(text, ''), '')")}, 1, {FV.RETRY_TEXT_LIMIT}) AS st
      FROM (SELECT doc_id, text, split_part(text, chr(10), 1) AS headline FROM documents))""",
          dates=())
def q_scorer_text(t):
    d = FX.documents_as_articles(spread(t.documents))
    lt = TX.long_scorer_text("summary", "headline", "content")
    st = TX.long_scorer_text("summary", "headline", "content", limit=FV.RETRY_TEXT_LIMIT)
    return d.select(F.col("news_id").alias("doc_id"),
                    TX.short_scorer_text("summary", "headline").alias("short_text"),
                    F.length(lt).cast("long").alias("long_len"), F.md5(lt).alias("long_md5"),
                    F.length(st).cast("long").alias("retry_len"))


@register("polar_score", ops="B12",
          sql="SELECT news_id, finbert_label, finbert_prob, finbert_sentiment FROM news",
          ctes=("news",), rnd=("finbert_prob", "finbert_sentiment"), dates=())
def q_polar(t):
    n = news(t)
    return n.select("news_id", "finbert_label", "finbert_prob",
                    TX.polar_score("finbert_label", "finbert_prob").alias("finbert_sentiment"))


def _lex_sql(words: tuple) -> str:
    arr = "[" + ", ".join(q(w) for w in words) + "]"
    return (f"len(list_filter(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}]+'), "
            f"lambda w: w <> ''), lambda w: list_contains({arr}, w)))")


@register("lexicon_score", ops="B13",
          sql=f"""SELECT doc_id, n_pos, n_neg, label, prob,
       CASE label WHEN 'positive' THEN prob WHEN 'negative' THEN -prob ELSE 0.0 END AS lexicon_sentiment
FROM (SELECT doc_id, n_pos, n_neg,
             CASE WHEN n_pos > n_neg THEN 'positive' WHEN n_neg > n_pos THEN 'negative' ELSE 'neutral' END AS label,
             CAST(greatest(n_pos, n_neg) + 1 AS DOUBLE) / CAST(n_pos + n_neg + 2 AS DOUBLE) AS prob
      FROM (SELECT doc_id, CAST({_lex_sql(FV.POSITIVE_WORDS)} AS INTEGER) AS n_pos,
                   CAST({_lex_sql(FV.NEGATIVE_WORDS)} AS INTEGER) AS n_neg FROM documents))""",
          rnd=("prob", "lexicon_sentiment"), dates=())
def q_lexicon(t):
    d = SC.lexicon_scorer()(spread(t.documents).select("doc_id", "text"), F.col("text"))
    return d.select("doc_id", F.col("_s.n_pos").alias("n_pos"), F.col("_s.n_neg").alias("n_neg"),
                    F.col("_s.label").alias("label"), F.col("_s.prob").alias("prob"),
                    TX.polar_score(F.col("_s.label"), F.col("_s.prob")).alias("lexicon_sentiment"))


_RAW_TS_SQL = ("CASE WHEN news_id % 13 = 0 THEN 'n/a' ELSE strftime(time, '%Y-%m-%dT%H:%M:%S') || "
               "CASE news_id % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '+02:00' ELSE '-05:00' END END")


@register("coalesce_nonempty", ops="B1 B2 B3 B4",
          sql=f"""SELECT news_id, ts, headline, coalesce(nullif(summary, ''), nullif(headline, '')) AS summary_or_headline
FROM (SELECT news_id, CASE WHEN news_id % 19 = 0 THEN NULL ELSE headline END AS headline, summary,
             CAST(timezone('UTC', TRY_CAST({_RAW_TS_SQL} AS TIMESTAMPTZ)) AS TIMESTAMP) AS ts FROM news)
WHERE ts IS NOT NULL AND ts >= TIMESTAMP '1996-01-01' AND headline IS NOT NULL AND headline <> ''""",
          ctes=("news",), dates=("ts",))
def q_coalesce(t):
    n = news(t)
    raw = (F.when(F.col("news_id") % 13 == 0, F.lit("n/a"))
           .otherwise(F.concat(F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss"),
                               F.when(F.col("news_id") % 3 == 0, "Z")
                               .when(F.col("news_id") % 3 == 1, "+02:00").otherwise("-05:00"))))
    head = F.when(F.col("news_id") % 19 == 0, F.lit(None).cast("string")).otherwise(F.col("headline"))
    x = n.select("news_id", head.alias("headline"), "summary",
                 parse_time(raw).alias("ts"))
    return (x.filter(F.col("ts").isNotNull() & (F.col("ts") >= F.lit("1996-01-01").cast("timestamp_ntz"))
                     & TX.first_nonempty("headline").isNotNull())
            .select("news_id", "ts", "headline",
                    TX.first_nonempty("summary", "headline").alias("summary_or_headline")))


_SHORT_SQL = "coalesce(nullif(summary, ''), nullif(headline, ''))"


@register("rescore_pending", ops="B8 B13 A13 A14",
          sql=f"""SELECT news_id,
       CASE WHEN gemma_sentiment_score IS NULL THEN
         CASE WHEN n_pos > n_neg THEN p WHEN n_neg > n_pos THEN -p ELSE 0.0 END
       ELSE gemma_sentiment_score END AS gemma_sentiment_score
FROM (SELECT news_id, gemma_sentiment_score, n_pos, n_neg,
             CAST(greatest(n_pos, n_neg) + 1 AS DOUBLE) / CAST(n_pos + n_neg + 2 AS DOUBLE) AS p
      FROM (SELECT news_id, gemma_sentiment_score,
                   CAST({_lex_sql(FV.POSITIVE_WORDS).replace('lower(text)', f'lower({_SHORT_SQL})')} AS INTEGER) AS n_pos,
                   CAST({_lex_sql(FV.NEGATIVE_WORDS).replace('lower(text)', f'lower({_SHORT_SQL})')} AS INTEGER) AS n_neg
            FROM news))""",
          ctes=("news",), rnd=("gemma_sentiment_score",), dates=())
def q_rescore(t):
    """Score only the articles still missing a score (scorer input: summary,
    else headline); the others pass through."""
    n = news(t).select("news_id", "summary", "headline", "gemma_sentiment_score")
    out = SC.rescore_pending(n, TX.short_scorer_text("summary", "headline"),
                             "gemma_sentiment_score")
    return out.select("news_id", "gemma_sentiment_score")

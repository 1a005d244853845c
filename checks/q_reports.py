"""Checks of quote matching, theme labelling, prompts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.adapter import Tables
from checks.registry import query
from themeloom.functions.weeks import iso_week_of
from themeloom.operators import filters, quotes, themes
from themeloom.operators.sampling import sample_for_prompt
from themeloom.plans import report
from themeloom.sources import config, responses

# Best score of every distinct quote of a run and the first review reaching it.
_MATCH_SQL = """
    SELECT run_id, quote AS text, max(score) AS best_score, arg_min(ord, (-score, ord)) AS ord,
           arg_min(rating, (-score, ord)) AS rating, arg_min(source, (-score, ord)) AS source,
           arg_min(review_date, (-score, ord)) AS review_date
    FROM (SELECT p.run_id, p.quote, p.ord, p.rating, p.source, p.review_date,
                 greatest(p.set_score, coalesce(100.0 - 100.0 * (c.la + c.lb - 2 * c.lcs)
                                                / CAST(2 * (c.s + c.sep) + c.la + c.lb AS DOUBLE), 0.0)) AS score
          FROM v_set_scores p LEFT JOIN v_commons c USING (run_id, quote, ord))
    GROUP BY run_id, quote"""


def _quotes(t: Tables) -> DataFrame:
    return responses.report_quotes(t.parsed)


def _named(t: Tables) -> DataFrame:
    return responses.report_themes(t.parsed)


@query(
    "read_report_json",
    """SELECT run_id, attempt, tokens_used, parsed, attempt_no, report_json->>'summary' AS summary,
              CAST(coalesce(json_array_length(report_json, '$.themes'), -1) AS INTEGER) AS n_themes
       FROM (SELECT * REPLACE (CASE WHEN parsed THEN report_json END AS report_json) FROM v_parsed)""",
)
def _parsed(t: Tables) -> DataFrame:
    n = F.when(F.col("report.themes").isNull(), -1).otherwise(F.size("report.themes"))
    return t.parsed.select(
        "run_id", "attempt", "tokens_used", "parsed", "attempt_no",
        F.col("report.summary").alias("summary"), n.alias("n_themes"),
    )


@query(
    "match_quotes",
    f"""SELECT run_id, text, round(best_score, 6) AS best_score, best_score >= 90 AS passed, ord, rating, source, review_date
        FROM ({_MATCH_SQL})""",
)
def _match(t: Tables) -> DataFrame:
    matches = quotes.match_quotes(_quotes(t), t.clustered, t.run_reviews)
    return matches.withColumn("best_score", F.round("best_score", 6))


@query(
    "validate_quotes",
    f"""SELECT run_id, attempt, pos, text, theme_label, best_score >= 90 AS passed,
               CASE WHEN best_score < 90 THEN round(best_score, 1) END AS best_score
        FROM v_quotes JOIN (SELECT run_id, text, best_score FROM ({_MATCH_SQL})) USING (run_id, text)""",
)
def _validate(t: Tables) -> DataFrame:
    return quotes.validate_quotes(_quotes(t), t.clustered, t.run_reviews)


@query(
    "best_match",
    f"""SELECT run_id, attempt, pos, ord, rating, source, review_date
        FROM v_quotes JOIN ({_MATCH_SQL}) USING (run_id, text)""",
)
def _best(t: Tables) -> DataFrame:
    matched = quotes.best_match(_quotes(t), t.clustered, t.run_reviews)
    return matched.select("run_id", "attempt", "pos", "ord", "rating", "source", "review_date")


_VERDICTS_SQL = f"(SELECT run_id, text, best_score >= 90 AS passed FROM ({_MATCH_SQL}))"


def _verdicts(t: Tables) -> DataFrame:
    return quotes.match_quotes(_quotes(t), t.clustered, t.run_reviews).select("run_id", "text", "passed")


@query(
    "drop_failed_quotes",
    f"SELECT run_id, attempt, pos, text, theme_label FROM v_quotes JOIN {_VERDICTS_SQL} USING (run_id, text) WHERE passed",
)
def _drop_failed(t: Tables) -> DataFrame:
    return quotes.drop_failed_quotes(_quotes(t), _verdicts(t).where("NOT passed"))


@query(
    "quote_totals",
    f"""SELECT run_id, attempt, count(*) AS total_quotes, count(*) FILTER (passed) AS passed_quotes,
              count(*) FILTER (NOT passed) AS failed_quotes, bool_and(passed) AS valid
       FROM v_quotes JOIN {_VERDICTS_SQL} USING (run_id, text) GROUP BY run_id, attempt""",
)
def _totals(t: Tables) -> DataFrame:
    return quotes.quote_totals(_quotes(t).join(_verdicts(t), ["run_id", "text"]), ("run_id", "attempt"))


_CHOSEN_SQL = """
    SELECT run_id, attempt, attempt_no, valid, tokens_used, report_json FROM (
      SELECT p.run_id, p.attempt, p.attempt_no, p.report_json, q.valid,
             CAST(sum(p.tokens_used) OVER (PARTITION BY p.run_id ORDER BY p.attempt) AS BIGINT) AS tokens_used, p.parsed
      FROM v_parsed p LEFT JOIN (SELECT run_id, attempt, bool_and(text NOT LIKE 'zzqx%') AS valid FROM v_quotes GROUP BY ALL) q
        USING (run_id, attempt))
    WHERE parsed AND attempt_no <= 3
    QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY valid DESC, CASE WHEN valid THEN attempt_no ELSE -attempt_no END) = 1"""


def _chosen(t: Tables) -> DataFrame:
    return t.chosen


@query(
    "select_attempt",
    f"SELECT run_id, attempt, attempt_no, valid, tokens_used FROM ({_CHOSEN_SQL})",
)
def _attempt(t: Tables) -> DataFrame:
    return _chosen(t).select("run_id", "attempt", "attempt_no", "valid", "tokens_used")


#: The checks from here on go on from the response that was chosen, as the job does.
_CHOSEN_KEYS_SQL = f"(SELECT run_id, attempt FROM ({_CHOSEN_SQL}))"


def of_chosen(t: Tables, rows: DataFrame) -> DataFrame:
    return rows.join(_chosen(t).select("run_id", "attempt"), ["run_id", "attempt"], "left_semi")


_LABELLED_SQL = f"""
    SELECT t.run_id, t.cluster_id, t.review_count, t.avg_rating,
           coalesce(trim(n.label), t.label) AS label, coalesce(trim(n.description), t.description) AS description
    FROM v_run_themes t LEFT JOIN (
      SELECT run_id, cluster_id, arg_max(label, pos) AS label, arg_max(description, pos) AS description
      FROM v_named WHERE (run_id, attempt) IN {_CHOSEN_KEYS_SQL} AND cluster_id IS NOT NULL GROUP BY run_id, cluster_id) n
    USING (run_id, cluster_id)"""


def _labelled(t: Tables) -> DataFrame:
    return themes.label_themes(t.run_themes, of_chosen(t, _named(t)))


@query("label_themes", _LABELLED_SQL)
def _label(t: Tables) -> DataFrame:
    return _labelled(t).select(
        "run_id", "cluster_id", "review_count", "avg_rating", "label", "description"
    )


@query(
    "label_memory",
    f"""SELECT t.run_id, t.cluster_id, coalesce(trim(n.label), t.label) AS label, coalesce(trim(n.description), t.description) AS description
        FROM v_run_themes t LEFT JOIN (
          SELECT v.run_id, cluster_id, arg_max(label, (v.attempt, pos)) AS label, arg_max(description, (v.attempt, pos)) AS description
          FROM v_named v JOIN {_CHOSEN_KEYS_SQL} c ON c.run_id = v.run_id AND v.attempt <= c.attempt
          WHERE cluster_id IS NOT NULL GROUP BY v.run_id, cluster_id) n USING (run_id, cluster_id)""",
)
def _memory(t: Tables) -> DataFrame:
    """Labels as all responses up to the chosen one leave them."""
    rows = themes.label_themes(t.run_themes, themes.named_so_far(_named(t), _chosen(t)))
    return rows.select("run_id", "cluster_id", "label", "description")


@query(
    "labelled_themes",
    "SELECT run_id, cluster_id FROM v_run_themes WHERE cluster_id % 3 <> 0",
)
def _with_label(t: Tables) -> DataFrame:
    blank = F.when(F.col("cluster_id") % 3 == 0, F.lit("")).otherwise(F.col("label"))
    return filters.labelled_themes(t.run_themes.withColumn("label", blank)).select("run_id", "cluster_id")


_RESOLVED_SQL = f"""
    SELECT q.run_id, q.attempt, q.pos, q.text, q.theme_label, n.cluster_id
    FROM v_quotes q LEFT JOIN (
      SELECT run_id, lower(trim(label)) AS k, arg_max(cluster_id, pos) AS cluster_id FROM v_named
      WHERE (run_id, attempt) IN {_CHOSEN_KEYS_SQL} AND cluster_id IS NOT NULL GROUP BY run_id, lower(trim(label))) n
    ON n.run_id = q.run_id AND n.k = lower(trim(q.theme_label)) WHERE (q.run_id, q.attempt) IN {_CHOSEN_KEYS_SQL}"""


def _resolved(t: Tables) -> DataFrame:
    return themes.quote_cluster(of_chosen(t, _quotes(t)), of_chosen(t, _named(t)))


@query("quote_cluster", f"SELECT run_id, pos, cluster_id FROM ({_RESOLVED_SQL})")
def _quote_cluster(t: Tables) -> DataFrame:
    return _resolved(t).select("run_id", "pos", "cluster_id")


# Facts of a quote, for the checks that print quotes without matching them first.
_SOURCED_SQL = f"""
    SELECT *, CAST(1 + pos % 5 AS INTEGER) AS rating, CASE WHEN pos % 2 = 0 THEN 'google_play' ELSE 'app_store' END AS source,
           DATE '2024-01-01' + CAST(pos AS INTEGER) AS review_date FROM ({_RESOLVED_SQL})"""


def _sourced(t: Tables) -> DataFrame:
    pos = F.col("pos")
    return _resolved(t).withColumns(
        {
            "rating": (1 + pos % 5).cast("int"),
            "source": F.when(pos % 2 == 0, "google_play").otherwise("app_store"),
            "review_date": F.date_add(F.lit("2024-01-01").cast("date"), pos),
        }
    )


@query(
    "quote_in_window",
    f"""SELECT run_id, pos FROM ({_SOURCED_SQL}) JOIN (SELECT DISTINCT run_id, window_start, window_end FROM v_run_reviews) USING (run_id)
        WHERE review_date BETWEEN window_start AND window_end""",
)
def _inside(t: Tables) -> DataFrame:
    windows = t.run_reviews.select("run_id", "window_start", "window_end").distinct()
    return filters.quote_in_window(_sourced(t).join(windows, "run_id")).select("run_id", "pos")


_SHOWN_SQL = f"""
    SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY cluster_id) AS theme_no FROM ({_LABELLED_SQL}) WHERE label <> ''
    QUALIFY theme_no <= 5"""


@query("top_themes", f"SELECT run_id, cluster_id, CAST(theme_no AS INTEGER) AS theme_no FROM ({_SHOWN_SQL})")
def _top_themes(t: Tables) -> DataFrame:
    return themes.top_themes(filters.labelled_themes(_labelled(t))).select("run_id", "cluster_id", "theme_no")


_PAIRED_SQL = f"""
    SELECT s.run_id, s.theme_no, s.label, q.pos, q.text, q.rating, q.source, q.review_date
    FROM (SELECT *, min(cluster_id) OVER (PARTITION BY run_id, label) AS tc FROM ({_SHOWN_SQL})) s
    JOIN ({_SOURCED_SQL}) q ON q.run_id = s.run_id AND q.cluster_id IS NOT DISTINCT FROM s.tc"""


@query(
    "theme_quotes",
    f"SELECT run_id, CAST(theme_no AS INTEGER) AS theme_no, pos, text FROM ({_PAIRED_SQL})",
)
def _theme_quotes(t: Tables) -> DataFrame:
    labelled = _labelled(t)
    rows = themes.theme_quotes(themes.top_themes(labelled), labelled, _sourced(t), None)
    return rows.select("run_id", "theme_no", "pos", "text")


@query(
    "theme_quotes_unresolved",
    f"""SELECT s.run_id, CAST(s.theme_no AS INTEGER) AS theme_no, q.pos FROM ({_SHOWN_SQL}) s JOIN ({_SOURCED_SQL}) q
        ON q.run_id = s.run_id AND q.cluster_id IS NULL""",
)
def _unresolved(t: Tables) -> DataFrame:
    rows = themes.theme_quotes(themes.top_themes(_labelled(t)), None, _sourced(t), None)
    return rows.select("run_id", "theme_no", "pos")


@query(
    "theme_quotes_by_label",
    f"""SELECT s.run_id, CAST(s.theme_no AS INTEGER) AS theme_no, q.pos FROM ({_SHOWN_SQL}) s JOIN ({_SOURCED_SQL}) q
        ON q.run_id = s.run_id AND lower(trim(q.theme_label)) = lower(trim(s.label))""",
)
def _by_label(t: Tables) -> DataFrame:
    rows = themes.theme_quotes_by_label(themes.top_themes(_labelled(t)), _sourced(t), None)
    return rows.select("run_id", "theme_no", "pos")


@query(
    "top_quotes",
    f"""SELECT run_id, CAST(theme_no AS INTEGER) AS theme_no, pos, text FROM (
          SELECT s.run_id, s.theme_no, q.pos, q.text FROM ({_SHOWN_SQL}) s JOIN v_quotes q
            ON q.run_id = s.run_id AND lower(trim(q.theme_label)) = lower(trim(s.label)) AND (q.run_id, q.attempt) IN {_CHOSEN_KEYS_SQL})
        QUALIFY row_number() OVER (PARTITION BY run_id, theme_no ORDER BY pos) <= 2""",
)
def _top_quotes(t: Tables) -> DataFrame:
    rows = themes.theme_quotes_by_label(themes.top_themes(_labelled(t)), _sourced(t), None)
    return themes.top_quotes(rows, 2).select("run_id", "theme_no", "pos", "text")


@query(
    "top_actions",
    """SELECT run_id, attempt, array_to_string(list_transform(json_extract_string(report_json, '$.action_ideas[*]')[1:5],
              lambda x: trim(x)), ';') AS actions FROM v_parsed WHERE parsed""",
)
def _actions(t: Tables) -> DataFrame:
    first = themes.top_actions(F.col("report.action_ideas"), 5)
    return t.parsed.where("parsed").select(
        "run_id", "attempt", F.array_join(F.transform(first, lambda x: F.trim(x)), ";").alias("actions")
    )


_SUMMARY_LINES_SQL = """
    SELECT run_id, cluster_id, 0 AS n, 'Cluster ' || (cluster_id + 1) || ': ' || review_count || ' reviews, avg rating '
           || CAST(CAST(round(CAST(avg_rating AS DECIMAL(6,2)), 1) AS DECIMAL(4,1)) AS VARCHAR) AS line FROM v_run_themes
    UNION ALL
    SELECT run_id, cluster_id, rank, '  - [' || rating || '★ ' || source || '] ' || replace(substr(text, 1, 150), chr(10), ' ')
    FROM v_prompt_sample WHERE rank <= 3"""
_SUMMARIES_SQL = f"""
    SELECT run_id, string_agg(line, chr(10) ORDER BY cluster_id, n) AS cluster_summaries FROM ({_SUMMARY_LINES_SQL}) GROUP BY run_id"""
_TEXTS_SQL = """
    SELECT run_id, string_agg('[' || ordinal || '] [' || rating || '★] [' || source || '] [' || review_date || '] ' || text,
                              chr(10) ORDER BY ordinal) AS review_texts FROM v_numbered GROUP BY run_id"""


def _sample(t: Tables) -> DataFrame:
    return sample_for_prompt(t.run_reviews)


@query("cluster_summaries", _SUMMARIES_SQL)
def _summaries(t: Tables) -> DataFrame:
    return report.cluster_summaries(t.run_themes, _sample(t))


@query("review_texts", _TEXTS_SQL)
def _texts(t: Tables) -> DataFrame:
    return report.review_texts(_sample(t))


def _configs(t: Tables) -> DataFrame:
    """Settings per product: some options set, some left to their defaults."""
    number = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    return t.table("documents").select("source").distinct().select(
        F.col("source").alias("product"),
        F.concat(F.lit("App "), F.col("source")).alias("display_name"),
        F.when(number % 2 == 0, 2 + number % 4).alias("max_themes"),
        F.when(number % 3 == 0, F.lit(2)).alias("max_quotes_per_theme"),
    )


_CONFIG_SQL = r"""
    SELECT product, 'App ' || product AS display_name, CASE WHEN k % 2 = 0 THEN 2 + k % 4 ELSE 5 END AS max_themes,
           CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS max_quotes_per_theme, 5 AS max_action_ideas, 4 AS max_reviews_per_cluster,
           180 AS max_review_chars, 'in' AS country, 'en' AS language
    FROM (SELECT DISTINCT source AS product, CAST(regexp_extract(source, '(\d+)', 1) AS INTEGER) AS k FROM documents)"""


@query("product_config", _CONFIG_SQL)
def _config(t: Tables) -> DataFrame:
    return config.product_config(_configs(t))


@query(
    "run_config",
    f"""SELECT r.doc_id, c.display_name, c.max_themes FROM v_reviews r JOIN ({_CONFIG_SQL}) c USING (product)""",
)
def _run_config(t: Tables) -> DataFrame:
    rows = config.run_config(t.reviews, config.product_config(_configs(t)))
    return rows.select("doc_id", "display_name", "max_themes")


def _run_rows(t: Tables) -> DataFrame:
    columns = ("run_id", "product", "week_start", "week_end", "window_start", "window_end")
    runs = t.run_reviews.groupBy(*columns).agg(F.count("*").alias("reviews_count"))
    named = config.run_config(runs, config.product_config(_configs(t)))
    return named.withColumn("iso_week", iso_week_of(F.col("week_start")))


def _text_sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_RUN_SQL = f"""
    SELECT r.*, c.* EXCLUDE (product), strftime(r.week_start, '%G-W%V') AS iso_week
    FROM (SELECT run_id, product, week_start, week_end, window_start, window_end, count(*) AS reviews_count
          FROM v_run_reviews GROUP BY ALL) r JOIN ({_CONFIG_SQL}) c USING (product)"""
_PROMPT_SQL = f"""
    SELECT run_id, total_reviews, num_clusters, max_themes * max_quotes_per_theme AS max_quotes,
      '<config>' || chr(10) || 'Product: ' || display_name || chr(10) || 'Report week: ' || iso_week || chr(10)
      || 'Report week range: ' || week_start || ' to ' || week_end || chr(10)
      || 'Review analysis window: ' || window_start || ' to ' || window_end || chr(10)
      || 'Total reviews: ' || total_reviews || chr(10) || 'Number of theme clusters: ' || num_clusters || chr(10) || '</config>'
      || chr(10) || chr(10) || '<clusters>' || chr(10) || cluster_summaries || chr(10) || '</clusters>'
      || chr(10) || chr(10) || '<reviews>' || chr(10) || review_texts || chr(10) || '</reviews>'
      || chr(10) || chr(10) || {_text_sql(report.REPLY_FORMAT)} || chr(10) || chr(10)
      || 'At most ' || max_themes || ' themes, most reviewed first; at most ' || max_themes * max_quotes_per_theme || ' quotes, spread over the themes; at most '
      || max_action_ideas || ' action ideas. Take quotes only from the reviews above, dated within ' || window_start || ' to ' || window_end || '.' AS prompt,
      replace({_text_sql(report.SYSTEM_TEXT)}, '{{product}}', display_name) AS system_text
    FROM ({_RUN_SQL}) JOIN (SELECT run_id, count(*) AS total_reviews FROM v_numbered GROUP BY run_id) USING (run_id)
      JOIN (SELECT run_id, count(*) AS num_clusters FROM v_run_themes GROUP BY run_id) USING (run_id)
      JOIN ({_SUMMARIES_SQL}) USING (run_id) JOIN ({_TEXTS_SQL}) USING (run_id)"""


@query(
    "prompt_pack",
    f"""SELECT *, CAST(length(prompt) + length(system_text) AS INTEGER) AS prompt_chars,
               (length(prompt) + length(system_text)) / 4.0::DOUBLE AS est_tokens FROM ({_PROMPT_SQL})""",
)
def _prompt(t: Tables) -> DataFrame:
    return report.prompt_pack(_run_rows(t), t.run_themes, _sample(t))


_DRAFT_THEMES_SQL = f"""
    SELECT run_id, string_agg(cluster_id || ':' || label || ':' || description || ':' || review_count, ';' ORDER BY cluster_id) AS themes
    FROM ({_LABELLED_SQL}) WHERE label <> '' GROUP BY run_id"""
_DRAFT_QUOTES_SQL = f"""
    SELECT run_id, string_agg(pos || ':' || text || ':' || rating || ':' || source || ':' || review_date, ';' ORDER BY pos) AS quotes
    FROM ({_SOURCED_SQL}) GROUP BY run_id"""
_FIRST_SQL = f"SELECT run_id, report_json FROM ({_CHOSEN_SQL})"


def _draft(t: Tables) -> DataFrame:
    return report.report_draft(of_chosen(t, t.parsed), _labelled(t), _sourced(t))


@query(
    "report_draft",
    f"""SELECT run_id, report_json->>'summary' AS summary,
               array_to_string(json_extract_string(report_json, '$.action_ideas[*]'), ';') AS actions, themes, quotes
        FROM ({_FIRST_SQL}) LEFT JOIN ({_DRAFT_THEMES_SQL}) USING (run_id) LEFT JOIN ({_DRAFT_QUOTES_SQL}) USING (run_id)""",
)
def _report_draft(t: Tables) -> DataFrame:
    theme_text = F.transform(
        "themes", lambda x: F.concat_ws(":", x["cluster_id"], x["label"], x["description"], x["review_count"])
    )
    quote_text = F.transform(
        "quotes", lambda x: F.concat_ws(":", x["pos"], x["text"], x["rating"], x["source"], x["review_date"])
    )
    return _draft(t).select(
        "run_id",
        "summary",
        F.array_join("action_ideas", ";").alias("actions"),
        F.array_join(theme_text, ";").alias("themes"),
        F.array_join(quote_text, ";").alias("quotes"),
    )


_THEME_LINES_SQL = f"""
    SELECT run_id, CAST(theme_no AS INTEGER) AS theme_no, theme_no || '. **' || trim(label) || '** — ' || trim(description) || ' (' || review_count
           || ' reviews, avg ★' || CAST(CAST(round(CAST(avg_rating AS DECIMAL(6,2)), 1) AS DECIMAL(4,1)) AS VARCHAR) || ')' AS line FROM ({_SHOWN_SQL})"""


@query("report_themes_view", _THEME_LINES_SQL)
def _view(t: Tables) -> DataFrame:
    return report.report_themes_view(_labelled(t))


_QUOTE_LINES_SQL = f"""
    SELECT run_id, theme_no, pos, '> "' || trim(text) || '" — ' || rating || '★, '
           || CASE WHEN source = 'google_play' THEN 'Google Play' ELSE 'App Store' END || ', ' || review_date || chr(10)
           || '> _' || trim(label) || ' · from analysis window_' || chr(10) AS line
    FROM ({_PAIRED_SQL}) QUALIFY row_number() OVER (PARTITION BY run_id, theme_no ORDER BY pos) <= 1"""
_LONG = "'%B %d, %Y'"


#: Every run's document.
MARKDOWN_SQL = f"""SELECT run_id, product, week_start, '# ' || display_name || ' — Weekly Review Report' || chr(10) || chr(10)
        || '**Reporting Week:** ' || strftime(week_start, {_LONG}) || ' – ' || strftime(week_end, {_LONG}) || chr(10)
        || '**Analysis Window:** ' || strftime(window_start, {_LONG}) || ' – ' || strftime(window_end, {_LONG}) || ' (10 weeks)' || chr(10)
        || '**Sources:** Google Play, Apple App Store' || chr(10) || '**Reviews Analyzed:** ' || reviews_count || chr(10) || chr(10)
        || '## Executive Summary' || chr(10) || trim(report_json->>'summary') || chr(10) || chr(10)
        || '## Top Themes' || chr(10) || coalesce(theme_text || chr(10), '') || chr(10)
        || '## Representative Quotes' || chr(10)
        || '_Quotes are drawn from the full analysis window and represent the most illustrative feedback for each theme._'
        || chr(10) || chr(10) || coalesce(quote_text || chr(10), '') || chr(10) || '## Action Ideas' || chr(10)
        || array_to_string(list_transform(json_extract_string(report_json, '$.action_ideas[*]')[1:5], lambda x: '- ' || trim(x)), chr(10))
        || chr(10) || chr(10) || '---' || chr(10) || '_Generated by themeloom · Run ID: ' || run_id || '_' || chr(10) AS content
        FROM ({_RUN_SQL}) JOIN ({_FIRST_SQL}) USING (run_id)
        LEFT JOIN (SELECT run_id, string_agg(line, chr(10) ORDER BY theme_no) AS theme_text FROM ({_THEME_LINES_SQL}) GROUP BY run_id) USING (run_id)
        LEFT JOIN (SELECT run_id, string_agg(line, chr(10) ORDER BY theme_no) AS quote_text FROM ({_QUOTE_LINES_SQL}) GROUP BY run_id) USING (run_id)"""


@query("render_markdown", MARKDOWN_SQL)
def markdown(t: Tables) -> DataFrame:
    return report.render_markdown(_draft(t), _run_rows(t), _labelled(t), _sourced(t))


@query(
    "render_html_summary",
    f"""SELECT run_id, display_name || ' Weekly Review Report — Week ' || iso_week AS subject,
        '<html>' || chr(10) || '<body>' || chr(10) || '<h2>' || display_name || ' — Weekly Review Report (Week ' || iso_week || ')</h2>' || chr(10)
        || '<h3>Executive Summary</h3>' || chr(10) || '<p>' || trim(report_json->>'summary') || '</p>' || chr(10)
        || '<h3>Top Themes This Week</h3>' || chr(10) || '<ul>' || chr(10) || items || chr(10) || '</ul>' || chr(10)
        || '<p><strong>Report:</strong> <a href="https://example.org/?a=1&amp;r=' || run_id || '">https://example.org/?a=1&amp;r=' || run_id || '</a></p>'
        || chr(10) || '<hr />' || chr(10) || '<p>Generated by themeloom.</p>' || chr(10) || '</body>' || chr(10) || '</html>' AS body
        FROM ({_RUN_SQL}) JOIN ({_FIRST_SQL}) USING (run_id) JOIN (
          SELECT run_id, string_agg('<li><strong>' || trim(label) || '</strong> — ' || trim(description) || ' (' || review_count || ' reviews, avg ★'
            || CAST(CAST(round(CAST(avg_rating AS DECIMAL(6,2)), 1) AS DECIMAL(4,1)) AS VARCHAR) || ')</li>', chr(10) ORDER BY cluster_id) AS items
          FROM ({_LABELLED_SQL}) GROUP BY run_id) USING (run_id)""",
)
def _html(t: Tables) -> DataFrame:
    url = F.concat(F.lit("https://example.org/?a=1&r="), F.col("run_id"))
    return report.render_html_summary(_draft(t), _run_rows(t).withColumn("report_url", url))

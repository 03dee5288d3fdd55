"""DuckDB statements whose results the Spark queries must equal.

All share the derived tables below. They are written independently of the Spark plans: nested lists
instead of long histories, row-by-row gaps instead of hourly cells, pair counts instead of rank sums.
"""

from __future__ import annotations

# The feature types of the user profile.
FEATURE_TYPES = {
    "mean_positive_score": "numerical",
    "mean_neutral_score": "numerical",
    "mean_negative_score": "numerical",
    "positive_sentiment_articles_rate": "numerical",
    "neutral_sentiment_articles_rate": "numerical",
    "negative_sentiment_articles_rate": "numerical",
    "favourite_device": "categorical",
    **{str(h): "numerical" for h in range(24)},
    "median_next_read_time": "numerical",
    "premium_propensity": "categorical",
    "reading_engagement": "categorical",
    "is_subscriber": "binary",
}


def r6(expression: str, name: str) -> str:
    """Six digits, without a negative zero."""
    return f'round(CAST({expression} AS DOUBLE), 6) + 0.0 AS "{name}"'


def draw(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT)"


def aid(k: str) -> str:
    return f"CASE WHEN {k} % 25 = 24 THEN -1 - {k} ELSE {k} END"


def number(step: int) -> str:
    return f"((k + {17 * step} + 100 * (event_id % greatest(n // 100, 1))) % greatest(n, 1))"


INVIEW = ", ".join(aid(number(i)) for i in range(5))

TABLES = {
    "ev": """
SELECT event_id, user_id, ts, event_type, value, n, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
       CASE WHEN ts < TIMESTAMP '2024-01-22 00:00:00' THEN 'train'
            WHEN ts < TIMESTAMP '2024-01-29 00:00:00' THEN 'validation' ELSE 'test' END AS split
FROM events, (SELECT count(*) AS n FROM documents)""",
    "articles": """
SELECT d.doc_id AS article_id, d.text AS body, coalesce(l.quality, 0) = 1 AND d.doc_id % 2 = 0 AS premium,
       CASE WHEN l.toxic = 1 THEN 'Negative' WHEN l.quality = 1 THEN 'Positive'
            WHEN l.doc_id IS NOT NULL THEN 'Neutral' END AS sentiment_label,
       CAST(d.n_chars % 100 AS DOUBLE) / 100 AS sentiment_score
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "behaviors": f"""
SELECT *, CASE WHEN event_type IN ('click', 'purchase') THEN [inview[1]]
               WHEN event_type = 'signup' THEN [inview[1], inview[2]] ELSE CAST([] AS BIGINT[]) END AS clicked
FROM (SELECT event_id AS impression_id, user_id, ts AS impression_time, split, event_type,
             CAST(1 + event_id % 3 AS INTEGER) AS device_type, user_id % 4 = 0 AS is_subscriber,
             CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS next_read_time,
             CAST([{INVIEW}] AS BIGINT[]) AS inview
      FROM ev)""",
    "entries": f"""
SELECT user_id, split, event_id, ts, {aid(number(0))} AS article_id,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS read_time,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE least(value, 100) END AS scroll
FROM ev""",
    "history": """
SELECT user_id, split, list(article_id ORDER BY ts, event_id) AS ids, list(ts ORDER BY ts, event_id) AS times,
       list(read_time ORDER BY ts, event_id) AS reads, list(scroll ORDER BY ts, event_id) AS scrolls
FROM entries GROUP BY user_id, split""",
    "recent": """
SELECT user_id, split, len(ids) - p AS lag, ids[p] AS article_id, reads[p] AS read_time, scrolls[p] AS scroll
FROM (SELECT *, unnest(range(greatest(len(ids) - 20, 0) + 1, len(ids) + 1)) AS p FROM history)""",
    "docvec": "SELECT vec_id AS article_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings",
    "runs": """
SELECT concat('run_', p_partkey) AS run_id, CAST(p_size % 5 + 1 AS INTEGER) AS npratio, 10 AS epochs,
       CAST(p_partkey % 4 * 5 + 10 AS INTEGER) AS history_size, CAST(p_partkey % 3 * 4 + 12 AS INTEGER) AS head_num,
       CAST(p_partkey % 5 * 4 + 8 AS INTEGER) AS head_dim,
       CASE WHEN p_partkey % 7 < 3 THEN 'pretransformed' ELSE 'lookup' END AS loader,
       CASE WHEN p_size % 2 = 0 THEN 'cross_entropy_loss' ELSE 'log_loss' END AS loss,
       CASE p_partkey % 8 WHEN 0 THEN 'Baseline' WHEN 1 THEN 'PE' WHEN 2 THEN 'RLN' WHEN 3 THEN 'PE+RLN'
            WHEN 4 THEN 'TD' WHEN 5 THEN 'PE+TD' WHEN 6 THEN 'RLN+TD' ELSE 'PE+RLN+TD' END AS model,
       CAST(p_partkey * 31 % 97 AS DOUBLE) / 97 AS auc, CAST(p_partkey * 31 % 89 AS DOUBLE) / 89 AS mrr,
       CAST(p_partkey * 17 % 83 AS DOUBLE) / 83 AS ndcg5, CAST(p_partkey * 13 % 79 AS DOUBLE) / 79 AS ndcg10
FROM part""",
    "scored_runs": "SELECT *, 0.5 * auc + 0.3 * mrr + 0.1 * ndcg5 + 0.1 * ndcg10 AS overall FROM runs",
    "device": """
SELECT user_id, CAST(trunc(median(device_type)) AS TINYINT) AS favourite_device
FROM behaviors WHERE split <> 'test' GROUP BY user_id""",
    "next_read": """
SELECT user_id, median(next_read_time) AS median_next_read_time
FROM behaviors WHERE split <> 'test' GROUP BY user_id""",
    "subscription": """
SELECT user_id, CAST(coalesce(bool_and(is_subscriber), true) AS FLOAT) AS is_subscriber
FROM behaviors WHERE split <> 'test' GROUP BY user_id""",
    "premium_use": """
SELECT user_id, CASE WHEN share < 0.2 THEN 1 WHEN share < 0.5 THEN 2 ELSE 3 END AS premium_propensity
FROM (SELECT user_id, CASE WHEN sum(len(clicked)) = 0 THEN 0 ELSE
               sum(len(list_filter(clicked, lambda a: list_contains(p.ids, a)))) / sum(len(clicked)) END AS share
      FROM behaviors, (SELECT list(article_id) AS ids FROM articles WHERE premium) p
      WHERE split = 'train' GROUP BY user_id)""",
    "engagement": """
SELECT user_id, split, CASE WHEN mean_read <= 45 THEN (CASE WHEN daily <= 5 THEN 1 ELSE 2 END)
                            ELSE (CASE WHEN daily <= 5 THEN 3 ELSE 4 END) END AS reading_engagement
FROM (SELECT user_id, split, list_avg(reads) AS mean_read,
             CAST(len(times) AS DOUBLE) / nullif(dayofyear(times[-1]) - dayofyear(times[1]), 0) AS daily
      FROM history)""",
    "sentiment_rows": """
SELECT r.user_id, r.article_id, a.sentiment_label AS label, a.sentiment_score AS score
FROM recent r LEFT JOIN articles a ON r.article_id = a.article_id WHERE r.split <> 'test'""",
    "sentiment": """
SELECT user_id,
       coalesce(avg(score) FILTER (label = 'Positive'), 0) AS mean_positive_score,
       coalesce(avg(score) FILTER (label = 'Neutral'), 0) AS mean_neutral_score,
       coalesce(avg(score) FILTER (label = 'Negative'), 0) AS mean_negative_score,
       count(*) FILTER (label = 'Positive') / count(*) AS positive_sentiment_articles_rate,
       count(*) FILTER (label = 'Neutral') / count(*) AS neutral_sentiment_articles_rate,
       count(*) FILTER (label = 'Negative') / count(*) AS negative_sentiment_articles_rate
FROM sentiment_rows GROUP BY user_id""",
    "numbered": """
SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY split, ts, event_id) AS session_no
FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id, split ORDER BY ts, event_id) <= INTERVAL 1 HOUR
                     THEN 0 ELSE 1 END AS fresh
      FROM entries WHERE split <> 'test')""",
    "sessions": """
SELECT user_id, split, CAST(session_no AS BIGINT) AS session_no, count(*) AS n_impressions,
       epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us,
       CAST(hour(make_timestamp(CAST(floor(avg(epoch_us(ts))) AS BIGINT))) AS INTEGER) AS session_hour
FROM numbered GROUP BY user_id, split, session_no HAVING count(*) >= 2""",
    "hours": "SELECT user_id, "
    + ", ".join(
        f'CAST(count(*) FILTER (session_hour = {h}) / count(*) AS FLOAT) AS "{h}"' for h in range(24)
    )
    + " FROM sessions GROUP BY user_id",
    "profile": """
SELECT h.user_id, s.* EXCLUDE (user_id), d.favourite_device, t.* EXCLUDE (user_id), n.median_next_read_time,
       p.premium_propensity, e.reading_engagement, b.is_subscriber
FROM history h JOIN sentiment s ON h.user_id = s.user_id JOIN device d ON h.user_id = d.user_id
     JOIN hours t ON h.user_id = t.user_id JOIN next_read n ON h.user_id = n.user_id
     JOIN premium_use p ON h.user_id = p.user_id
     JOIN engagement e ON h.user_id = e.user_id AND e.split = 'train'
     JOIN subscription b ON h.user_id = b.user_id
WHERE h.split <> 'test'""",
    "padded": """
SELECT user_id, split, list_concat(list_resize(CAST([] AS BIGINT[]), greatest(20 - len(ids), 0), 0),
                                   ids[greatest(len(ids) - 20, 0) + 1 : len(ids)]) AS ids
FROM history""",
    "clicks": """
SELECT impression_id, user_id, split, impression_time, unnest(clicked) AS click, unclicked
FROM (SELECT *, list_filter(inview, lambda a: NOT list_contains(clicked, a)) AS unclicked FROM behaviors)
WHERE len(unclicked) > 0""",
    "drawn": f"""
SELECT impression_id, user_id, split, impression_time, click, -1 AS i, click AS article_id, 1 AS label FROM clicks
UNION ALL
SELECT impression_id, user_id, split, impression_time, click, i,
       unclicked[1 + {draw('impression_id', 'click', 'i', "'123'")} % len(unclicked)], 0
FROM clicks, range(5) t(i)""",
    "few_drawn": f"""
SELECT *, {draw('impression_id', 'click', 'a', "'order'", "'123'")} AS o
FROM (SELECT *, row_number() OVER (PARTITION BY impression_id, click
                                   ORDER BY {draw('impression_id', 'click', 'a', "'draw'", "'123'")}, a) AS place
      FROM (SELECT impression_id, click, unnest(unclicked) AS a FROM clicks)) WHERE place <= 3
UNION ALL
SELECT impression_id, click, click AS a, 0 AS place, {draw('impression_id', 'click', 'click', "'order'", "'123'")} FROM clicks""",
    "samples": f"""
SELECT impression_id, user_id, split, impression_time, click, list(article_id ORDER BY o, i) AS ids,
       list(label ORDER BY o, i) AS labels
FROM (SELECT *, {draw('impression_id', 'click', 'i', "'order'", "'123'")} AS o FROM drawn)
GROUP BY ALL""",
    "user_vectors": """
SELECT user_id, split, list(v ORDER BY d) AS vector
FROM (SELECT user_id, split, d, sum(w * x) / sum(w) AS v
      FROM (SELECT r.user_id, r.split, exp(-0.05 * r.lag) AS w, unnest(v.vector) AS x,
                   generate_subscripts(v.vector, 1) AS d
            FROM recent r JOIN docvec v ON r.article_id = v.article_id)
      GROUP BY user_id, split, d)
GROUP BY user_id, split""",
    "shown": """
SELECT impression_id, user_id, split, CAST(pos - 1 AS INTEGER) AS pos, inview[pos] AS article_id,
       CAST(list_contains(clicked, inview[pos]) AS TINYINT) AS label
FROM (SELECT *, unnest(range(1, len(inview) + 1)) AS pos FROM behaviors)""",
    "scores": """
SELECT s.*, coalesce(list_dot_product(u.vector, v.vector), 0.0) AS score
FROM shown s LEFT JOIN user_vectors u ON s.user_id = u.user_id AND s.split = u.split
     LEFT JOIN docvec v ON s.article_id = v.article_id""",
    "ranked": """
SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, pos) AS rank FROM scores""",
    "pair_auc": """
SELECT p.impression_id, avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END) AS auc
FROM scores p JOIN scores n ON p.impression_id = n.impression_id AND p.label = 1 AND n.label = 0
GROUP BY p.impression_id""",
    "per_impression": """
SELECT impression_id, any_value(split) AS split, sum(label) AS clicked,
       sum(label / rank) / nullif(sum(label), 0) AS mrr,
       sum(CASE WHEN label = 1 AND rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END)
         / nullif(sum(CASE WHEN best <= 5 AND best_label = 1 THEN 1 / log2(best + 1) ELSE 0 END), 0) AS ndcg5,
       sum(CASE WHEN label = 1 AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END)
         / nullif(sum(CASE WHEN best <= 10 AND best_label = 1 THEN 1 / log2(best + 1) ELSE 0 END), 0) AS ndcg10
FROM (SELECT *, label AS best_label, row_number() OVER (PARTITION BY impression_id ORDER BY label DESC, pos) AS best
      FROM ranked)
GROUP BY impression_id""",
    "labelled": "SELECT *, CAST(user_id % 3 AS INTEGER) AS label FROM profile",
    "feature_rows": """
SELECT scope, unnest(["""
    + ", ".join(
        f"struct_pack(feature := '{f}', kind := '{t}', value := CAST(\"{f}\" AS DOUBLE))"
        for f, t in FEATURE_TYPES.items()
    )
    + """], recursive := true)
FROM (SELECT *, unnest([CAST(label AS VARCHAR), 'global']) AS scope FROM labelled)""",
    "centred": """
SELECT *, value - avg(value) OVER (PARTITION BY scope, feature) AS c FROM feature_rows WHERE kind = 'numerical'""",
    "moments": """
SELECT scope, feature, any_value(kind) AS kind, avg(value) AS mean, median(value) AS median, stddev_samp(value) AS std,
       list_sort(list(value))[CAST(floor(0.25 * (count(value) - 1) + 0.5) AS BIGINT) + 1] AS q25,
       list_sort(list(value))[CAST(floor(0.75 * (count(value) - 1) + 0.5) AS BIGINT) + 1] AS q75,
       avg(c ** 3) / nullif(avg(c ** 2) ** 1.5, 0) AS skewness_index,
       avg(c ** 4) / nullif(avg(c ** 2) ** 2, 0) - 3 AS kurtosis_index
FROM centred WHERE value IS NOT NULL GROUP BY scope, feature""",
    "kinds": """
SELECT scope, feature, any_value(kind) AS kind, value, count(*) AS n
FROM feature_rows WHERE kind <> 'numerical' GROUP BY scope, feature, value""",
    "shares": """
SELECT *, CASE WHEN value IS NOT NULL THEN n / sum(n) FILTER (value IS NOT NULL) OVER (PARTITION BY scope, feature)
          END AS f FROM kinds""",
    "indices": """
SELECT scope, feature, any_value(kind) AS kind, arg_max(value, n - value / 1e6) AS mode, max(f) AS mode_rate,
       CAST(count(*) AS SMALLINT) AS n_unique,
       CASE WHEN count(value) > 1 THEN count(value) * (1 - sum(f * f)) / (count(value) - 1) ELSE 0 END AS gini,
       CASE WHEN count(value) > 1 THEN -sum(f * log2(f)) / log2(count(value)) ELSE 0 END AS entropy
FROM shares GROUP BY scope, feature""",
    "summary": """
SELECT scope, feature, kind AS feature_type, mean, median, std, q25, q75, skewness_index, kurtosis_index,
       CAST(NULL AS DOUBLE) AS mode, CAST(NULL AS DOUBLE) AS mode_rate, CAST(NULL AS SMALLINT) AS n_unique,
       CAST(NULL AS DOUBLE) AS gini, CAST(NULL AS DOUBLE) AS entropy
FROM moments
UNION ALL BY NAME
SELECT scope, feature, kind AS feature_type, mode, mode_rate, n_unique, gini, entropy FROM indices""",
}

PRELUDE = "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in TABLES.items())

HOURS = [str(h) for h in range(24)]
SENTIMENT = [
    f"{head}{name}{tail}"
    for head, tail in (("mean_", "_score"), ("", "_sentiment_articles_rate"))
    for name in ("positive", "neutral", "negative")
]
SUMMARY_NUMBERS = ["mean", "median", "std", "q25", "q75", "skewness_index", "kurtosis_index", "mode", "mode_rate"]


def columns6(names: list[str]) -> str:
    return ", ".join(r6(f'"{n}"', n) for n in names)


def joined(expression: str, name: str) -> str:
    return f"array_to_string({expression}, ',') AS {name}"


def standard(name: str) -> str:
    return f'coalesce(("{name}" - avg("{name}") OVER ()) / nullif(stddev_pop("{name}") OVER (), 0), 0)'


def difference(name: str) -> str:
    return f"abs(c.{name} - g.{name}) / nullif(g.{name}, 0)"


SPOILT = "CAST(substr(run_id, 5) AS BIGINT) % 50"


def mapped(ids: str, values: str, name: str) -> str:
    return joined(f"list_transform({ids}, lambda a: CAST(coalesce({values}[a], 0) AS BIGINT))", name)


RESULT_COLUMNS = """
run_id AS "run id", false AS "debug", 'small' AS "datasplit", 'data' AS "data path",
'vectors.parquet' AS "document embeddings", CAST(128 AS SMALLINT) AS "bs train", CAST(128 AS SMALLINT) AS "bs test",
CAST(128 AS SMALLINT) AS "batch size test wo b", CAST(8 AS TINYINT) AS "batch size test w b",
CAST(1.0 AS DOUBLE) AS "fraction test", CAST(10 AS SMALLINT) AS "n chunks test", CAST(0 AS SMALLINT) AS "chunks done",
CAST(1 AS SMALLINT) AS "train fraction", CAST(200 AS SMALLINT) AS "attention hidden dimension",
CAST(768 AS SMALLINT) AS "title size", CAST(0.0001 AS DOUBLE) AS "learning rate",
CAST(0.0001 AS DOUBLE) AS "newsencoder l2 regularization", '512,512,512' AS "newsencoder units per layer",
'adam' AS "optimizer", loss AS "loss", CAST(0.2 AS DOUBLE) AS "dropout", CAST(123 AS TINYINT) AS "seed",
CAST(epochs AS TINYINT) AS "epochs", CAST(history_size AS TINYINT) AS "history size",
CAST(npratio AS TINYINT) AS "npratio", CAST(head_num AS TINYINT) AS "head num", CAST(head_dim AS TINYINT) AS "head dim",
loader AS "nrms loader", model AS "used model",
""" + ", ".join(r6(a, b) for a, b in (("auc", "auc"), ("mrr", "mrr"), ("ndcg5", "ndcg@5"), ("ndcg10", "ndcg@10")))

CORRELATIONS = " UNION ALL ".join(
    f"SELECT '{label}' AS metric, '{name}' AS parameter, "
    f"CASE WHEN stddev_pop({value}) > 0 THEN corr({metric}, {value}) END AS correlation FROM runs"
    for metric, label in (("auc", "auc"), ("mrr", "mrr"), ("ndcg5", "ndcg@5"), ("ndcg10", "ndcg@10"))
    for name, value in (
        ("encoded loss", "CASE WHEN loss = 'cross_entropy_loss' THEN 1 ELSE 2 END"),
        ("npratio", "npratio"),
        ("epochs", "epochs"),
        ("history size", "history_size"),
        ("head num", "head_num"),
        ("head dim", "head_dim"),
        ("encoded loader", "CASE WHEN loader = 'pretransformed' THEN 1 ELSE 2 END"),
    )
)

BODIES = {
    "premium_articles": f"SELECT article_id, {r6('premium', 'premium')} FROM articles",
    "premium_articles_test": f"""
SELECT doc_id AS article_id, {r6('doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)', 'premium')} FROM documents""",
    "article_length": "SELECT article_id, CAST(length(body) AS INTEGER) AS article_length FROM articles",
    "article_features": f"""
SELECT v.article_id, {r6('a.premium', 'premium')}, CAST(length(a.body) AS INTEGER) AS article_length,
       CAST(len(v.vector) AS INTEGER) AS n_dims, {r6('sqrt(list_dot_product(v.vector, v.vector))', 'vector_norm')}
FROM docvec v JOIN articles a ON v.article_id = a.article_id""",
    "favourite_device": "SELECT * FROM device",
    "median_next_read_time": f"SELECT user_id, {columns6(['median_next_read_time'])} FROM next_read",
    "subscription_status": f"SELECT user_id, {columns6(['is_subscriber'])} FROM subscription",
    "subscription_consistency": """
SELECT user_id, CAST(count(DISTINCT coalesce(CAST(is_subscriber AS VARCHAR), '?')) AS INTEGER) AS n_unique
FROM behaviors WHERE split <> 'test' GROUP BY user_id""",
    "premium_clicks": """
SELECT impression_id, user_id, split, click AS article_id
FROM (SELECT *, unnest(clicked) AS click FROM behaviors)
WHERE click IN (SELECT article_id FROM articles WHERE premium)""",
    "premium_propensity": "SELECT * FROM premium_use",
    "reading_engagement": "SELECT user_id, reading_engagement FROM engagement WHERE split = 'train'",
    "reading_engagement_test": "SELECT user_id, reading_engagement FROM engagement WHERE split = 'test'",
    "history_union": f"""
SELECT user_id, split, event_id, article_id, epoch_us(ts) AS impression_us, {r6('read_time', 'read_time')},
       {r6('scroll', 'scroll_percentage')}
FROM entries WHERE split = 'train'
UNION ALL
SELECT user_id, split, event_id, article_id, epoch_us(ts), round(read_time, 6), round(scroll, 6)
FROM entries WHERE split = 'validation'""",
    "history_tail": f"""
SELECT user_id, split, CAST(lag AS INTEGER) AS lag, article_id, {r6('read_time', 'read_time')},
       {r6('scroll', 'scroll_percentage')} FROM recent""",
    "article_length_propensity": """
SELECT user_id, CASE WHEN length <= 2000 THEN (CASE WHEN scroll <= 60 THEN 1 ELSE 2 END)
                     ELSE (CASE WHEN scroll <= 60 THEN 3 ELSE 4 END) END AS article_length_propensity
FROM (SELECT r.user_id, median(CASE WHEN a.article_id IS NULL THEN 0 ELSE length(a.body) END) AS length,
             median(r.scroll) AS scroll
      FROM recent r LEFT JOIN articles a ON r.article_id = a.article_id WHERE r.split = 'train' GROUP BY r.user_id)""",
    "sentiment_stats": f"SELECT user_id, {columns6(SENTIMENT)} FROM sentiment",
    "sentiment_article_lists": "SELECT user_id, "
    + ", ".join(
        f"coalesce(array_to_string(list(article_id ORDER BY article_id) FILTER (label = '{s.capitalize()}'), ','), '')"
        f" AS {s}_article_ids"
        for s in ("positive", "neutral", "negative")
    )
    + " FROM sentiment_rows GROUP BY user_id",
    "user_sessions": "SELECT * FROM sessions",
    "session_hour_propensity": f"""
SELECT user_id, session_hour, count(*) AS n_sessions,
       {r6('CAST(count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS FLOAT)', 'propensity')}
FROM sessions GROUP BY user_id, session_hour""",
    "time_profile": f"SELECT user_id, {columns6(HOURS)} FROM hours",
    "user_profile": f"""
SELECT user_id, {columns6(SENTIMENT + HOURS + ['median_next_read_time', 'is_subscriber'])}, favourite_device,
       premium_propensity, reading_engagement FROM profile""",
    "impressions_with_history": f"""
SELECT b.impression_id, b.user_id, b.split, {joined('p.ids', 'article_id_fixed')},
       {joined('b.inview', 'article_ids_inview')}, {joined('b.clicked', 'article_ids_clicked')}
FROM behaviors b JOIN padded p ON b.user_id = p.user_id AND b.split = p.split""",
    "sampled_impressions": f"""
SELECT impression_id, user_id, split FROM behaviors
WHERE {draw('impression_id', "'123'")} < CAST(floor(0.3 * 4294967296) AS BIGINT)""",
    "negative_samples": f"""
SELECT impression_id, click AS clicked_article_id, {joined('ids', 'article_ids_inview')}, {joined('labels', 'labels')}
FROM samples""",
    "list_sessions": "SELECT * FROM sessions",
    "distinct_negative_samples": f"""
SELECT impression_id, click AS clicked_article_id, {joined('list(a ORDER BY o, a)', 'article_ids_inview')},
       {joined('list(CASE WHEN place = 0 THEN 1 ELSE 0 END ORDER BY o, a)', 'labels')}
FROM few_drawn GROUP BY impression_id, click""",
    "item_features_lists": f"""
SELECT b.impression_id, {mapped('p.ids', 'premium', 'article_id_fixed_premium')},
       {mapped('p.ids', 'lengths', 'article_id_fixed_article_length')},
       {mapped('b.inview', 'premium', 'article_ids_inview_premium')},
       {mapped('b.inview', 'lengths', 'article_ids_inview_article_length')}
FROM behaviors b JOIN padded p ON b.user_id = p.user_id AND b.split = p.split,
     (SELECT map(list(article_id), list(CAST(premium AS INTEGER))) AS premium,
             map(list(article_id), list(length(body))) AS lengths FROM articles)""",
    "loaded_split": f"""
SELECT b.impression_id, b.user_id, b.split, {joined('p.ids', 'article_id_fixed')},
       {joined('b.inview', 'article_ids_inview')}
FROM behaviors b JOIN padded p ON b.user_id = p.user_id AND b.split = p.split WHERE b.split <> 'test'""",
    "rewritten_split": f"""
SELECT impression_id, user_id, split FROM behaviors
WHERE split <> 'validation' OR {draw('impression_id', "'123'")} < CAST(floor(0.5 * 4294967296) AS BIGINT)""",
    "submission_file": """
SELECT row_number() OVER (ORDER BY impression_id) AS line,
       impression_id || ' [' || array_to_string(list(rank ORDER BY pos), ',') || ']' AS value
FROM ranked GROUP BY impression_id""",
    "preprocessing_variants": """
SELECT concat('run_', p_partkey) AS "run id",
       CASE p_partkey % 8 WHEN 0 THEN 'Baseline' WHEN 1 THEN 'PP' WHEN 2 THEN 'RE' WHEN 3 THEN 'PP+RE' WHEN 4 THEN 'ALP'
            WHEN 5 THEN 'PP+ALP' WHEN 6 THEN 'RE+ALP' ELSE 'PP+RE+ALP' END AS "used model"
FROM part""",
    "run_files_report": f"""
SELECT CAST(CAST(substr(run_id, 5) AS BIGINT) // 100 AS VARCHAR) AS sweep, count(*) AS n_runs,
       count(*) FILTER ({SPOILT} NOT IN (3, 7, 13, 21)) AS n_complete, count(*) FILTER ({SPOILT} = 3) AS n_no_config,
       count(*) FILTER ({SPOILT} = 13) AS n_no_metrics, count(*) FILTER ({SPOILT} = 7) AS n_corrupt_config,
       count(*) FILTER ({SPOILT} = 21) AS n_corrupt_metrics
FROM runs GROUP BY ALL""",
    "run_files_results": f"SELECT {RESULT_COLUMNS} FROM runs WHERE {SPOILT} NOT IN (3, 7, 13, 21)",
    "binary_labels": f"""
SELECT impression_id, {joined('inview', 'article_ids_inview')},
       {joined('list_transform(inview, lambda a: CAST(list_contains(clicked, a) AS INTEGER))', 'labels')}
FROM behaviors""",
    "temporal_split": """
SELECT impression_id, CASE WHEN CAST(impression_time AS DATE) <
         (SELECT max(CAST(impression_time AS DATE)) - 1 FROM behaviors) THEN 'train' ELSE 'validation' END AS part
FROM behaviors""",
    "padded_lists": f"""
SELECT impression_id, {joined('list_resize(inview, (SELECT max(len(inview)) FROM behaviors), 0)', 'padded_inview')}
FROM behaviors""",
    "item_features_inview": f"""
SELECT impression_id,
       {joined('list_transform(inview, lambda a: CAST(list_contains(p.ids, a) AS INTEGER))', 'premium')}
FROM behaviors, (SELECT list(article_id) AS ids FROM articles WHERE premium) p""",
    "training_impressions": f"""
SELECT f.* EXCLUDE (impression_time),
       CASE WHEN CAST(impression_time AS DATE) < max(CAST(impression_time AS DATE)) OVER () - 1
            THEN 'train' ELSE 'validation' END AS part
FROM (SELECT s.impression_id, s.click AS clicked_article_id, s.user_id, s.split, s.impression_time,
             {joined('h.ids', 'article_id_fixed')}, {joined('s.ids', 'article_ids_inview')},
             {joined('s.labels', 'labels')}, p.premium_propensity, e.reading_engagement
      FROM samples s JOIN padded h ON s.user_id = h.user_id AND s.split = h.split
           JOIN premium_use p ON s.user_id = p.user_id
           JOIN engagement e ON s.user_id = e.user_id AND e.split = 'train'
      WHERE s.split <> 'test') f""",
    "test_impressions": f"""
SELECT b.impression_id, b.user_id, {joined('h.ids', 'article_id_fixed')}, {joined('b.inview', 'article_ids_inview')},
       '' AS article_ids_clicked, {joined('list_transform(b.inview, lambda a: 0)', 'labels')},
       0 AS premium_propensity, e.reading_engagement
FROM behaviors b JOIN padded h ON b.user_id = h.user_id AND b.split = h.split
     JOIN engagement e ON b.user_id = e.user_id AND e.split = 'test'
WHERE b.split = 'test'""",
    "evaluation_impressions": f"""
SELECT b.impression_id, b.user_id, {joined('h.ids', 'article_id_fixed')}, {joined('b.inview', 'article_ids_inview')},
       {joined('b.clicked', 'article_ids_clicked')},
       {joined('list_transform(b.inview, lambda a: CAST(list_contains(b.clicked, a) AS INTEGER))', 'labels')},
       p.premium_propensity, e.reading_engagement
FROM behaviors b JOIN padded h ON b.user_id = h.user_id AND b.split = h.split
     JOIN premium_use p ON b.user_id = p.user_id JOIN engagement e ON b.user_id = e.user_id AND e.split = 'train'
WHERE b.split = 'validation'""",
    "vector_lists": f"""
SELECT article_id, CAST(len(vector[-20:]) AS INTEGER) AS n_tail, {r6('list_avg(vector[-20:])', 'tail_mean')},
       {r6('list_median(vector)', 'median')}, {r6('list_max(steps)', 'largest_step')},
       {r6('list_avg(list_transform(list_zip(vector[2:], steps), lambda e: e[1] * e[2]))', 'mean_product')}
FROM (SELECT *, list_transform(list_zip(vector[2:], vector[:-2]), lambda e: e[1] - e[2]) AS steps FROM docvec)""",
    "click_features": f"""
SELECT s.impression_id, s.pos, s.article_id, s.label, {r6('s.score', 'match')},
       {r6('CASE WHEN a.premium THEN 1 ELSE 0 END', 'premium')}, p.premium_propensity, e.reading_engagement
FROM scores s LEFT JOIN articles a ON s.article_id = a.article_id JOIN premium_use p ON s.user_id = p.user_id
     JOIN engagement e ON s.user_id = e.user_id AND e.split = 'train'
WHERE s.split = 'validation'""",
    "time_decay_profile": f"""
SELECT user_id, split, CAST(len(vector) AS INTEGER) AS n_dims, {r6('list_sum(vector)', 'total')},
       {r6('sqrt(list_dot_product(vector, vector))', 'norm')}, {r6('vector[1]', 'first_dim')},
       {r6('vector[-1]', 'last_dim')}
FROM user_vectors""",
    "candidate_scores": f"""
SELECT impression_id, pos, article_id, label, {r6('score', 'score')},
       {r6('exp(score) / sum(exp(score)) OVER (PARTITION BY impression_id)', 'probability')},
       {r6('1 / (1 + exp(-score))', 'pointwise')}
FROM scores""",
    "ranked_predictions": f"""
SELECT impression_id, {joined('list(rank ORDER BY pos)', 'ranked_scores')} FROM ranked GROUP BY impression_id""",
    "submission_lines": """
SELECT impression_id || ' [' || array_to_string(list(rank ORDER BY pos), ',') || ']' AS value
FROM ranked GROUP BY impression_id""",
    "ranking_metrics": f"""
SELECT i.split, {r6('avg(a.auc)', 'auc')}, {r6('avg(i.mrr)', 'mrr')}, {r6('avg(i.ndcg5)', 'ndcg@5')},
       {r6('avg(i.ndcg10)', 'ndcg@10')}, count(*) AS n_impressions,
       count(*) FILTER (a.auc IS NULL) AS n_skipped
FROM per_impression i LEFT JOIN pair_auc a ON i.impression_id = a.impression_id GROUP BY i.split""",
    "experiment_results": f"SELECT {RESULT_COLUMNS} FROM runs",
    "model_variants": 'SELECT run_id AS "run id", model AS "used model" FROM runs',
    "param_correlations": f"""
SELECT metric, parameter, {r6('correlation', 'correlation')},
       CAST(row_number() OVER (PARTITION BY metric ORDER BY correlation DESC NULLS LAST, parameter) AS INTEGER) AS rank
FROM ({CORRELATIONS})""",
    "overall_score": f"""
SELECT run_id AS "run id", model AS "used model", {r6('overall', 'overall score')} FROM scored_runs
ORDER BY overall DESC""",
    "winners_per_model": f"""
SELECT model AS "used model", run_id AS "run id", loss, npratio, {r6('overall', 'overall score')} FROM scored_runs s
WHERE overall = (SELECT max(overall) FROM scored_runs t WHERE t.model = s.model)""",
    "best_run": f"""
SELECT run_id AS "run id", model AS "used model", {r6('overall', 'overall score')} FROM scored_runs
ORDER BY overall DESC, run_id LIMIT 1""",
    "cluster_labels": "SELECT DISTINCT CAST(user_id % 3 AS INTEGER) AS label FROM history WHERE split <> 'test'",
    "cluster_summary": f"""
SELECT scope, feature, feature_type, {columns6(SUMMARY_NUMBERS)}, n_unique,
       {r6('gini', 'normalized_gini_index')}, {r6('entropy', 'normalized_entropy_index')}
FROM summary""",
    "discriminating_features": f"""
SELECT *, CASE WHEN feature_type = 'numerical'
               THEN coalesce(means_relative_difference > 0.1 AND statistical_relevance > 1.0, false)
               ELSE coalesce(mode_rate_relative_difference > 0.1
                             OR (n_gini_index_relative_difference > 0.1 AND n_entropy_index_relative_difference > 0.1),
                             false) END AS is_discriminating
FROM (SELECT c.scope AS label, c.feature, c.feature_type,
             {r6(difference('mean'), 'means_relative_difference')},
             {r6('abs(c.mean - g.mean) / nullif(g.std, 0)', 'statistical_relevance')},
             {r6(difference('mode_rate'), 'mode_rate_relative_difference')},
             {r6(difference('gini'), 'n_gini_index_relative_difference')},
             {r6(difference('entropy'), 'n_entropy_index_relative_difference')}
      FROM summary c JOIN summary g ON c.feature = g.feature AND g.scope = 'global' WHERE c.scope <> 'global')""",
    "standardised_users": "SELECT user_id, " + ", ".join(r6(standard(f), f) for f in FEATURE_TYPES) + " FROM profile",
    "feature_covariances": f"""
SELECT names[a] AS feature_a, names[b] AS feature_b, {r6('avg(v[a] * v[b])', 'covariance')}
FROM (SELECT [{', '.join(f"CAST({standard(f)} AS DOUBLE)" for f in FEATURE_TYPES)}] AS v FROM profile),
     (SELECT [{', '.join(f"'{f}'" for f in FEATURE_TYPES)}] AS names),
     (SELECT unnest(range(1, {len(FEATURE_TYPES) + 1})) AS a), (SELECT unnest(range(1, {len(FEATURE_TYPES) + 1})) AS b)
WHERE a <= b GROUP BY ALL""",
}

BODIES["metrics_file"] = BODIES["ranking_metrics"]

ORACLE = {name: f"{PRELUDE}\n{body.strip()}" for name, body in BODIES.items()}

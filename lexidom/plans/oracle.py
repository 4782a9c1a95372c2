"""The derived inputs and features once more, as plain SQL for the checks."""

from __future__ import annotations

from ..ml.trees import POISSON as _POISSON
from ..schema import FEATURES_6

# DuckDB's edit distance counts bytes: letters beyond ASCII become unused ASCII signs first.
_LETTERS, _SIGNS = "'àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿß'", "'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%'"
EDIT_DISTANCE = (
    f"levenshtein(translate(domain, {_LETTERS}, {_SIGNS}), translate(prev, {_LETTERS}, {_SIGNS}))::DOUBLE"
)

def _lexical(source: str, prefix: str = "") -> dict[str, tuple[list[str], str]]:
    """Dictionary and trigram features of a CTE with a domain column."""
    x = prefix
    return {
        f"{x}pron": ([source, "tri"], f"""
        SELECT domain, CASE WHEN length(domain) < 3 THEN 0.0::DOUBLE
                            ELSE avg(coalesce(p, 1e-10::DOUBLE)) END AS pronounceability
        FROM (SELECT domain, substr(domain, i, 3) AS gram
              FROM (SELECT domain, unnest(range(1, greatest(length(domain) - 1, 2))) AS i
                    FROM {source})) g
        LEFT JOIN tri USING (gram) GROUP BY domain"""),
        f"{x}hits": ([source, "dic"], f"""
        SELECT domain, s + l AS e, l
        FROM (SELECT domain, s, unnest(range(1, length(domain) - s + 1)) AS l
              FROM (SELECT domain, unnest(range(0, length(domain))) AS s FROM {source})) x
        JOIN dic ON dic.word = substr(domain, s + 1, l)"""),
        f"{x}ends": ([f"{x}hits"], f"SELECT domain, e, list(l) AS ls FROM {x}hits GROUP BY domain, e"),
        # Recursive: the best cover of the first j characters, for growing j.
        f"{x}cov": ([source, f"{x}ends"], f"""
        SELECT domain, length(domain) AS n, 0::BIGINT AS j, [0::BIGINT] AS best FROM {source}
        UNION ALL
        SELECT c.domain, c.n, c.j + 1, list_append(c.best, greatest(c.best[c.j + 1], coalesce(
          list_max(list_transform(ends.ls, lambda l: c.best[c.j + 2 - l] + l)), 0)))
        FROM {x}cov c LEFT JOIN {x}ends ends ON ends.domain = c.domain AND ends.e = c.j + 1
        WHERE c.j < c.n"""),
        f"{x}words": ([f"{x}cov", f"{x}hits"], f"""
        SELECT domain, best[n + 1]::DOUBLE / n AS meaningful_word_ratio,
               coalesce(longest, 0)::DOUBLE / n AS lms_percentage
        FROM {x}cov LEFT JOIN (SELECT domain, max(l) AS longest FROM {x}hits GROUP BY domain)
        USING (domain) WHERE j = n"""),
    }


# name -> (CTEs it reads, query).
CTES: dict[str, tuple[list[str], str]] = {
    "tok": ([], """
        SELECT doc_id, lang, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS w
        FROM documents"""),
    "every_tok": ([], """
        SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w
        FROM documents"""),
    "benign": (["tok"], "SELECT DISTINCT w AS domain FROM tok"),
    "dom": (["benign"], """
        SELECT domain, min(label) AS label FROM (
          SELECT domain, 0 AS label FROM benign UNION ALL
          SELECT translate(substr(md5(domain), 1, greatest(length(domain), 6)), '01234567', 'ghijklmn'), 1
          FROM benign) GROUP BY domain"""),
    "ordd": (["dom"], "SELECT domain, label, row_number() OVER (ORDER BY domain) - 1 AS ord FROM dom"),
    "dic": (["tok"], """
        SELECT DISTINCT w AS word FROM tok WHERE lang = 'en'"""),
    "gram_counts": (["dom"], """
        SELECT substr(domain, i, 3) AS gram, count(*) AS cnt
        FROM (SELECT domain, unnest(range(1, length(domain) - 1)) AS i FROM dom WHERE label = 0)
        GROUP BY 1"""),
    "tri": (["gram_counts"], """
        SELECT gram, cnt, cnt::DOUBLE / (SELECT sum(cnt) FROM gram_counts)::DOUBLE AS p
        FROM gram_counts"""),
    "simple": (["ordd"], """
        SELECT domain, label, ord, length(domain)::DOUBLE AS length,
               length(regexp_replace(domain, '[^0-9]', '', 'g'))::DOUBLE / length(domain)
                 AS numerical_ratio,
               coalesce(lag(domain) OVER (ORDER BY ord), domain) AS prev
        FROM ordd"""),
    "feats": (["simple", "words", "pron"], f"""
        SELECT domain, label, ord, length, numerical_ratio, meaningful_word_ratio,
               pronounceability, lms_percentage, {EDIT_DISTANCE} AS levenshtein
        FROM simple JOIN words USING (domain) JOIN pron USING (domain)"""),
    "split_feats": (["split_dom", "words", "pron"], f"""
        SELECT domain, label, split, ord, length(domain)::DOUBLE AS length,
               length(regexp_replace(domain, '[^0-9]', '', 'g'))::DOUBLE / length(domain) AS numerical_ratio,
               meaningful_word_ratio, pronounceability, lms_percentage, {EDIT_DISTANCE} AS levenshtein
        FROM (SELECT *, row_number() OVER w - 1 AS ord, coalesce(lag(domain) OVER w, domain) AS prev
              FROM split_dom WINDOW w AS (PARTITION BY split ORDER BY domain))
        JOIN words USING (domain) JOIN pron USING (domain)"""),
    "predicted": (["dom", "pron"], """
        SELECT domain, label, pronounceability, CASE WHEN pronounceability < 1e-4 THEN 1 ELSE 0 END AS prediction
        FROM dom JOIN pron USING (domain)"""),
    "chunked": (["feats"], """
        SELECT *, ntile(256) OVER (ORDER BY ord) - 1 AS chunk, substr(md5(domain), 1, 3) AS h
        FROM feats"""),
    # Features with planted faults, see queries.faulty_features.
    "faulty": (["chunked"], """
        SELECT domain, ord, chunk,
          CASE h WHEN '002' THEN -1.0 ELSE length END AS length,
          CASE h WHEN '000' THEN 'NaN'::DOUBLE ELSE numerical_ratio END AS numerical_ratio,
          CASE h WHEN '005' THEN -0.5 ELSE meaningful_word_ratio END AS meaningful_word_ratio,
          CASE h WHEN '001' THEN 'Infinity'::DOUBLE ELSE pronounceability END AS pronounceability,
          CASE h WHEN '003' THEN 1.5 ELSE lms_percentage END AS lms_percentage,
          CASE h WHEN '004' THEN -1.0 ELSE levenshtein END AS levenshtein
        FROM chunked WHERE h <> '006'"""),
    "report": (["chunked", "faulty"], """
        SELECT chunk, n_rows, bad_nan, bad_inf, bad_length, bad_numerical_ratio,
          bad_meaningful_word_ratio, bad_pronounceability, bad_lms_percentage, bad_levenshtein,
          CASE WHEN n_rows <> expected_rows THEN 'shape' WHEN bad_nan > 0 THEN 'nan'
               WHEN bad_inf > 0 THEN 'inf' WHEN bad_length > 0 THEN 'length'
               WHEN bad_numerical_ratio > 0 THEN 'numerical_ratio'
               WHEN bad_meaningful_word_ratio > 0 THEN 'meaningful_word_ratio'
               WHEN bad_pronounceability > 0 THEN 'pronounceability'
               WHEN bad_lms_percentage > 0 THEN 'lms_percentage'
               WHEN bad_levenshtein > 0 THEN 'levenshtein' END AS reason
        FROM (SELECT chunk, count(*) AS expected_rows FROM chunked GROUP BY chunk) x
        JOIN (SELECT chunk, count(*) AS n_rows,
                count(*) FILTER (isnan(numerical_ratio)) AS bad_nan,
                count(*) FILTER (isinf(pronounceability)) AS bad_inf,
                count(*) FILTER (length < 0) AS bad_length,
                count(*) FILTER (NOT isnan(numerical_ratio) AND (numerical_ratio < -1e-9
                  OR numerical_ratio > 1 + 1e-9)) AS bad_numerical_ratio,
                count(*) FILTER (meaningful_word_ratio < -1e-9 OR meaningful_word_ratio > 1 + 1e-9)
                  AS bad_meaningful_word_ratio,
                count(*) FILTER (pronounceability < -1e-9) AS bad_pronounceability,
                count(*) FILTER (lms_percentage < -1e-9 OR lms_percentage > 1 + 1e-9)
                  AS bad_lms_percentage,
                count(*) FILTER (levenshtein < -1e-9) AS bad_levenshtein
              FROM faulty GROUP BY chunk) y USING (chunk)"""),
    "split_dom": (["dom"], """
        SELECT domain, label, CASE WHEN place <= round(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split
        FROM (SELECT domain, label, count(*) OVER (PARTITION BY label) AS n,
                row_number() OVER (PARTITION BY label ORDER BY md5(domain || '|42'), domain) AS place
              FROM dom)"""),
    # The derived raw log, as it must look after the parse.
    "raw": (["every_tok"], """
        SELECT translate(w, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')
                 || CASE lang WHEN 'en' THEN '.co.uk' WHEN 'de' THEN '.de'
                                     WHEN 'fr' THEN '.fr' ELSE '.com' END AS domain,
               CASE WHEN toxic = 1 THEN 'dga' ELSE 'benign' END AS threat, doc_id
        FROM every_tok LEFT JOIN labels USING (doc_id)
        UNION ALL SELECT 'Doc' || doc_id || '.co.uk', 'other', doc_id FROM documents"""),
    "raw_labelled": (["raw"], """
        SELECT domain, threat, CASE WHEN threat = 'dga' THEN 1 ELSE 0 END AS label, doc_id FROM raw"""),
    "cleaned": (["raw_labelled"], """
        SELECT domain, min(label) AS label FROM (
          SELECT regexp_replace(lower(domain), '[.](co[.]uk|de|fr|com)$', '') AS domain, label
          FROM raw_labelled) GROUP BY domain"""),
    "requests": ([], """
        SELECT w AS domain, count(*) AS n_requests FROM (
          SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w
          FROM conversations) GROUP BY w"""),
    **_lexical("dom"),
    **_lexical("requests", "r_"),
    # Run metrics read from the event stream.
    "runs0": ([], """
        SELECT CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 4
                 WHEN 'signup' THEN 8 ELSE 16 END AS k,
               event_id AS rep, value AS time_sec,
               json_extract(props, '$.k')::DOUBLE AS cpu_util_avg,
               json_extract(props, '$.k')::DOUBLE / 10 AS ipc_overhead_pct
        FROM events"""),
    "runs": (["runs0"], """
        SELECT *, base / time_sec AS speedup, base / time_sec / k AS efficiency,
               125000 * k AS n, 125000 * k / time_sec AS throughput,
               cpu_util_avg - 50 AS mem_delta_mb
        FROM runs0, (SELECT median(time_sec) AS base FROM runs0 WHERE k = 1)"""),
    "platform_runs": ([], """
        SELECT l_linestatus AS platform, l_linenumber AS k, l_quantity AS time_sec,
               l_extendedprice / 1000 AS speedup, l_tax * 100 AS ipc_overhead_pct,
               l_discount * 100 AS cpu_util_avg
        FROM lineitem"""),
}


def tree_ctes(name: str, depth: int, trees: int = 1, n_features: int | None = None, bootstrap: bool = False) -> dict:
    """Exact trees on the train rows of split_feats, level by level; test rows walk along."""
    features = [*FEATURES_6]
    x = ", ".join(f"round({c}, 12)" if c == "pronounceability" else c for c in features)
    u = "('0x' || substr(md5(concat_ws('|', domain, tree::VARCHAR, '42')), 1, 8))::BIGINT"
    weight = " + ".join(f"({u} >= {limit})::BIGINT" for limit in _POISSON) if bootstrap else "1::BIGINT"
    train = "split = 'train' AND w > 0 AND length(node) = "
    hashed = "md5(concat_ws('|', tree::VARCHAR, node, f::VARCHAR, '42'))"
    allowed = "" if not n_features else f"""
          QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY substr({hashed}, 1, 8), f) <= {n_features}"""
    ctes = {f"{name}0": (["split_feats"], f"""
        SELECT tree::INTEGER AS tree, domain, label AS y, split, {weight} AS w, [{x}] AS x, 'r' AS node
        FROM split_feats, (SELECT unnest(range({trees})) AS tree)""")}
    for k in range(depth + 1):
        ctes[f"{name}{k}_sum"] = ([f"{name}{k}"], f"""
        SELECT tree, node, sum(w)::BIGINT AS n, sum(w * y)::BIGINT AS n1 FROM {name}{k}
        WHERE {train}{k + 1} GROUP BY ALL""")
        if k == depth:
            continue
        ctes[f"{name}{k}_cut"] = ([f"{name}{k}_sum"], f"""
        SELECT tree, node, f, v + (next_v - v) / 2 AS threshold FROM (
          SELECT *, (s0 * r + s1 * l)::HUGEINT AS top, (l * r)::HUGEINT AS under FROM (
            SELECT *, l::HUGEINT * l - 2 * l::HUGEINT * l1 + 2 * l1::HUGEINT * l1 AS s0,
              r::HUGEINT * r - 2 * r::HUGEINT * r1 + 2 * r1::HUGEINT * r1 AS s1 FROM (
              SELECT tree, node, f, v, lead(v) OVER o AS next_v,
                sum(n) OVER o AS l, sum(n1) OVER o AS l1,
                sum(n) OVER g - sum(n) OVER o AS r, sum(n1) OVER g - sum(n1) OVER o AS r1
              FROM (
                SELECT tree, node, f, x[f + 1] AS v, sum(w)::BIGINT AS n, sum(w * y)::BIGINT AS n1
                FROM {name}{k} JOIN (
                  SELECT tree, node, f FROM {name}{k}_sum, (SELECT unnest(range({len(features)}))::INTEGER AS f)
                  WHERE n1 > 0 AND n1 < n{allowed}) USING (tree, node)
                WHERE {train}{k + 1} GROUP BY ALL)
              WINDOW g AS (PARTITION BY tree, node, f), o AS (PARTITION BY tree, node, f ORDER BY v)))
          WHERE next_v IS NOT NULL)
        QUALIFY row_number() OVER (PARTITION BY tree, node
          ORDER BY top // under DESC, (top % under)::DOUBLE / under::DOUBLE DESC, f, v) = 1""")
        ctes[f"{name}{k + 1}"] = ([f"{name}{k}", f"{name}{k}_cut"], f"""
        SELECT tree, domain, y, split, w, x, node || CASE WHEN f IS NULL THEN ''
          WHEN x[f + 1] <= threshold THEN '0' ELSE '1' END AS node
        FROM {name}{k} LEFT JOIN {name}{k}_cut USING (tree, node)""")
    names = "[" + ", ".join(f"'{c}'" for c in features) + "]"
    ctes[f"{name}_nodes"] = ([f"{name}{k}_sum" for k in range(depth + 1)], " UNION ALL ".join(f"""
        SELECT tree, node, {k} AS depth, n, n1, {f"{names}[f + 1]" if k < depth else "NULL"} AS feature,
          {"threshold" if k < depth else "NULL::DOUBLE"} AS threshold, (2 * n1 > n)::INTEGER AS prediction,
          n1::DOUBLE / n AS p1
        FROM {name}{k}_sum {f"LEFT JOIN {name}{k}_cut USING (tree, node)" if k < depth else ""}""" for k in range(depth + 1)))
    ctes[f"{name}_votes"] = ([f"{name}{depth}", f"{name}_nodes"], f"""
        SELECT domain, any_value(y) AS label, sum(p1) / count(*) AS p_dga, count_if(p1 > 0.5)::INTEGER AS votes
        FROM {name}{depth} JOIN {name}_nodes USING (tree, node) WHERE split = 'test' GROUP BY domain""")
    return ctes


CTES |= tree_ctes("cart", 3) | tree_ctes("forest", 3, trees=5, n_features=2, bootstrap=True)


def with_ctes(names: str, select: str) -> str:
    """``select`` with the CTEs it names and all that those read."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for needed in CTES[name][0]:
                visit(needed)
            order.append(name)

    for name in names.split():
        visit(name)
    body = ",\n".join(f"{name} AS ({CTES[name][1]})" for name in order)
    return f"WITH RECURSIVE {body}\n{select}" if order else select

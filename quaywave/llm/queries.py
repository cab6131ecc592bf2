"""The registered queries of the corpus operators and, where SQL can tell the rows, their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_documents
from .ann import nearest_neighbours
from .chat import digest_chats, format_chats
from .exact_dedup import grace_dedup
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .packing import pack_documents
from .pii import find_pii, spell
from .quality import RULES as QUALITY_RULES
from .quality import judge_quality
from .sharding import shard_documents
from .toxicity import fit_toxicity, held_out, score_toxicity
from .url_filter import RULES, judge_urls

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace_dedup(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(("email", "ip", "card", "phone"))),
        F.sha2(spell(F.col("base")), 256).alias("base_sha256"),
        spell(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = score_toxicity(docs, net)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


SAYS_TEMPLATE = "\\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SAYS_TEMPLATE).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return digest_chats(format_chats(turns))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = {"groups_sha256": F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")}
    aligned, _ = align_documents(table(spark, sf_dir, "documents"), keep=digest)
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("reason")


def _url_sql() -> str:
    """Rules, and block decisions over canonical links and refresh redirects by plain reachability."""
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lambda x: low(f"coalesce(regexp_extract({x}, '(?s)^.*?://([^/?#]*)', 1), '')")
    path = lambda x: f"coalesce(regexp_extract({x}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"

    def node(x: str) -> str:
        bare = f"regexp_replace({x}, '(?s)#.*$', '')"
        head, rest = f"regexp_extract({bare}, '(?s)^(.*?://[^/?#]*)', 1)", f"regexp_extract({bare}, '(?s)^.*?://[^/?#]*(.*)$', 1)"
        return f"CASE WHEN {head} <> '' THEN {low(head)} || CASE WHEN {rest} LIKE '/%' THEN {rest} ELSE '/' || {rest} END END"

    def absolute(link: str, url: str) -> str:
        """A link against an address: RFC 3986, with . and .. steps taken."""
        base, query = path(url), f"regexp_extract({link}, '(?s)^[^?]*(\\?.*)$', 1)"
        root = f"regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
        steps = f"string_split(regexp_extract({base}, '(?s)^/(.*/)[^/]*$', 1) || regexp_extract({link}, '(?s)^([^?]*)', 1), '/')"
        taken = f"list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform({steps}, lambda x: [x])), lambda a, x: CASE WHEN x[1] = '..' THEN list_slice(a, 1, len(a) - 1) WHEN x[1] = '.' THEN a ELSE list_concat(a, x) END)"
        ends = f"CASE WHEN list_extract({steps}, -1) IN ('.', '..') THEN [''] ELSE CAST([] AS VARCHAR[]) END"
        return f"""CASE WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {link}
            WHEN starts_with({link}, '//') THEN regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*:)//', 1) || {link}
            WHEN starts_with({link}, '/') THEN {root} || {link}
            WHEN {link} = '' OR {root} = '' OR regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
            WHEN starts_with({link}, '?') THEN {root} || {base} || {query}
            ELSE {root} || '/' || array_to_string(list_concat({taken}, {ends}), '/') || {query} END"""

    def case(pick: int) -> str:
        whens = []
        for rule in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
            name, slash, rest = rule[1].partition("/")
            whens.append(f"WHEN (host = '{name}' OR host LIKE '%.{name}') AND starts_with(path, '{slash}{rest}') THEN '{rule[pick]}'")
        return "CASE " + " ".join(whens) + " END"

    return rf"""
        WITH RECURSIVE tags AS (
            SELECT url, html, unnest(regexp_extract_all(html, '(?i)<link\b[^<>]*>')) AS tag, 'link' AS kind FROM pages WHERE regexp_matches(html, '(?i)canonical')
            UNION ALL SELECT url, html, unnest(regexp_extract_all(html, '(?i)<meta\b[^<>]*>')), 'meta' FROM pages WHERE regexp_matches(html, '(?i)http-equiv')),
        found AS (
            SELECT url, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?i)<base\b[^<>]*\bhref\s*=\s*["'']?([^"''\s>]*)', 1), '(?i)&amp;', '&', 'g'), '#.*$', '')) AS base, trim(regexp_replace(regexp_replace(CASE kind
                WHEN 'link' THEN CASE WHEN regexp_matches(tag, '(?i)\brel\s*=\s*("[^"]*\bcanonical\b|''[^'']*\bcanonical\b|canonical\b)') THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]*)', 1) END
                ELSE CASE WHEN regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?i)\bcontent\s*=\s*["'']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*["'']?([^"''>]*)', 1) END END,
                '(?i)&amp;', '&', 'g'), '#.*$', '')) AS link FROM tags),
        based AS (SELECT url, link, coalesce({node(absolute("base", "url"))}, url) AS base FROM found),
        whole AS (SELECT url, {absolute("link", "base")} AS link FROM based),
        edges AS (SELECT {node("url")} AS u, {node("link")} AS v FROM whole),
        both_ways AS (SELECT u, v FROM edges WHERE u <> v UNION SELECT v, u FROM edges WHERE u <> v),
        reach(node, other) AS (SELECT u, u FROM both_ways UNION SELECT r.node, b.v FROM reach r JOIN both_ways b ON b.u = r.other),
        told AS (SELECT node, {case(0)} AS said FROM (SELECT node, {host("other")} AS host, {path("other")} AS path FROM reach)),
        blocked AS (SELECT node FROM told GROUP BY node HAVING bool_or(said = 'block') AND NOT coalesce(bool_or(said = 'allow'), false)),
        judged AS (SELECT page_id, host, path, {case(1)} AS rule, {case(0)} AS said, node FROM (SELECT page_id, {host("url")} AS host, {path("url")} AS path, {node("url")} AS node FROM pages))
        SELECT page_id, host, path, rule, coalesce(said, CASE WHEN node IN (SELECT node FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict FROM judged"""


def _quality_sql() -> str:
    """Counts from exploded words and lines; binomial sums by lgamma; the cutoffs and the verdicts of fit_cutoffs and apply_cutoffs."""
    measures = ", ".join(f"CAST({text.replace(' div ', ' // ')} AS INT)" for text in QUALITY_RULES.values())
    rules, risk = len(QUALITY_RULES), 0.05 / len(QUALITY_RULES)
    return rf"""
        WITH texts AS (SELECT row_number() OVER () AS row, doc_id, lang, coalesce(text, '') AS text FROM documents),
        words AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT row, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts)),
        windows AS (SELECT row, i, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM words WINDOW o AS (PARTITION BY row ORDER BY i)),
        twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, a, b, c) AS n FROM windows WHERE c IS NOT NULL) WHERE n > 1),
        covered AS (SELECT row, count(DISTINCT i + k) AS n FROM twice, range(3) r(k) GROUP BY row),
        counted AS (SELECT row, count(*) AS n, sum(length(word)) AS chars FROM words GROUP BY row),
        lines AS (SELECT row, unnest(string_split(text, chr(10))) AS line FROM texts),
        lined AS (SELECT row, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row),
        stats AS (
            SELECT t.row, doc_id, lang AS stratum, text, coalesce(w.n, 0) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars,
                   length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                   coalesce(l.n, 0) AS n_lines, coalesce(dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
                   length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS n_upper
            FROM texts t LEFT JOIN counted w USING (row) LEFT JOIN lined l USING (row) LEFT JOIN covered c USING (row)),
        measured AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [{measures}] AS measures FROM stats),
        told AS (SELECT doc_id, max(quality) = 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
        held AS (SELECT stratum, bool_or(good) AS good, any_value(measures) AS measures FROM measured JOIN told USING (doc_id) WHERE NOT base_failed GROUP BY stratum, text),
        shares AS (SELECT stratum, count(*) > (SELECT count(*) FROM held) // 1024 AS named FROM held GROUP BY stratum),
        each AS (
            SELECT NOT named AS pooled, CASE WHEN named THEN h.stratum END AS stratum, good, unnest(measures) AS cutoff, unnest(range({rules})) AS rule
            FROM held h JOIN shares s ON h.stratum IS NOT DISTINCT FROM s.stratum),
        counts AS (SELECT pooled, stratum, rule, cutoff, count(*) FILTER (good) AS g, count(*) FILTER (NOT good) AS b FROM each GROUP BY ALL),
        tried AS (SELECT *, sum(g) OVER beyond AS lost, sum(b) OVER beyond AS caught, sum(g) OVER whole AS good, sum(b) OVER whole AS bad FROM counts
                  WINDOW whole AS (PARTITION BY pooled, stratum, rule), beyond AS (PARTITION BY pooled, stratum, rule ORDER BY cutoff DESC)),
        sizes AS (SELECT pooled, stratum, CAST(max(good) AS BIGINT) AS n FROM tried GROUP BY ALL),
        terms AS (SELECT pooled, stratum, n, k, CASE WHEN k <= n THEN exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({risk!r}) + (n - k) * ln(1 - {risk!r})) ELSE 0 END AS p
                  FROM (SELECT *, unnest(range(CAST(ceil(n * {risk!r}) AS BIGINT) + 2)) AS k FROM sizes)),
        sums AS (SELECT *, sum(p) OVER (PARTITION BY pooled, stratum ORDER BY k) AS below FROM terms),
        limits AS (SELECT pooled, stratum, coalesce(max(k) FILTER (below <= 0.05 / ({rules} * (SELECT count(*) FROM sizes))), -1) AS allowed FROM sums GROUP BY ALL),
        passed AS (SELECT t.*, caught / greatest(bad, 1) - 50 * lost / greatest(good, 1) AS worth FROM tried t JOIN limits l ON t.pooled = l.pooled AND t.stratum IS NOT DISTINCT FROM l.stratum WHERE lost <= allowed),
        chosen AS (SELECT pooled, stratum, rule, max_by(cutoff, (round(worth, 12), cutoff)) AS cutoff, max(round(worth, 12)) AS worth, any_value(good) AS good, any_value(bad) AS bad FROM passed WHERE worth > 0 GROUP BY ALL),
        met AS (SELECT h.good, h.measures, NOT named AS pooled, CASE WHEN named THEN h.stratum END AS stratum, row_number() OVER () AS text FROM held h JOIN shares s ON h.stratum IS NOT DISTINCT FROM s.stratum),
        firsts AS (SELECT m.good, m.pooled, m.stratum, c.rule FROM met m JOIN chosen c ON m.pooled = c.pooled AND m.stratum IS NOT DISTINCT FROM c.stratum AND m.measures[c.rule + 1] >= c.cutoff
                   QUALIFY row_number() OVER (PARTITION BY m.text ORDER BY c.worth DESC, c.rule) = 1),
        owns AS (SELECT pooled, stratum, rule, count(*) FILTER (good) AS lost, count(*) FILTER (NOT good) AS caught FROM firsts GROUP BY ALL),
        cutoffs AS (SELECT c.pooled, c.stratum, c.rule, c.cutoff FROM chosen c JOIN owns o ON c.pooled = o.pooled AND c.stratum IS NOT DISTINCT FROM o.stratum AND c.rule = o.rule
                    WHERE o.caught / greatest(c.bad, 1) - 50 * o.lost / greatest(c.good, 1) > 0),
        hit AS (
            SELECT DISTINCT row FROM measured m JOIN cutoffs c ON m.measures[c.rule + 1] >= c.cutoff
            AND CASE WHEN EXISTS (SELECT 1 FROM cutoffs o WHERE NOT o.pooled AND o.stratum IS NOT DISTINCT FROM m.stratum)
                     THEN NOT c.pooled AND c.stratum IS NOT DISTINCT FROM m.stratum ELSE c.pooled END)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND row NOT IN (SELECT row FROM hit) AS kept FROM measured"""


QUERIES: dict[str, Query] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_pii": op2_pii,
    "op3_mix_sources": op3_mix_sources,
    "op4_ann": op4_ann,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_toxicity": op6_toxicity,
    "op7_near_dedup": op7_near_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_shards": op9_shards,
    "op10_chat_format": op10_chat_format,
    "op11_align": op11_align,
    "op12_quality": op12_quality,
}

ORACLES: dict[str, str] = {
    "op8_url_filter": _url_sql(),
    "op12_quality": _quality_sql(),
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op10_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(k)),
        sized AS (
            SELECT *, role = 'assistant' AS hit,
                   length(role) + length(text) + length(regexp_replace(text, '[^\\|]', '', 'g')) + 18 AS chars,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS final
            FROM turns),
        running AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS prefix FROM sized)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (hit), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (hit), '')) AS loss_sha256,
               CAST(sum(prefix) FILTER (hit OR final) AS BIGINT) AS formatted_chars
        FROM running GROUP BY conv_id""",
}

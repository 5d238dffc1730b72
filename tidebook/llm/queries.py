"""Registered queries of the corpus operators and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm import decontaminate, divergence, kneser_ney, language_id, licenses, line_dedup, near_dedup, periodic, pii, quality_rules, quotes, sentencepiece, token_files
from tidebook.llm.common import SPACE_GAP, Scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A-Z in lower case, NULL as the empty text.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED = r"[^\x20\x09-\x0D]+"


def register(name: str, oracle: str | None = None):
    def add(query: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = oracle
        return query

    return add


@register(
    "op3_winnowing_decontamination",
    f"""
    WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM documents),
    i AS (SELECT item_id, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM benchmark),
    item_windows AS (
      SELECT DISTINCT item_id, n, list_slice(w, p, p + n - 1) AS words
      FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)
    ),
    sizes AS (SELECT DISTINCT n FROM item_windows),
    places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n),
    hits AS (
      SELECT doc_id, p, places.n, item_id
      FROM (SELECT doc_id, p, n, list_slice(w, p, p + n - 1) AS words FROM places) AS places JOIN item_windows USING (n, words)
    ),
    covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
    listed AS (
      SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
      CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
    """,
)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def tokenizer_file(name: str) -> str:
    """Where the box keeps its public vocabulary files; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op7_sentencepiece")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    model = sentencepiece.load(tokenizer_file("piece_bpe_32k.model"))
    encoded = sentencepiece.encode(table(spark, folder, "documents").select("doc_id", "text"), model).drop("text")
    return sentencepiece.decode(encoded, model).select(
        "doc_id",
        (F.length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register(
    "op4_line_dedup",
    rf"""
    WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
    lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS line_no FROM docs),
    visible AS (SELECT *, length(line) AS n FROM lines WHERE regexp_matches(line, '{SPACED}')),
    firsts AS (SELECT line, any_value(n) AS n, min({{'d': doc_id, 'l': line_no}}) AS place FROM visible GROUP BY line),
    long AS (SELECT * FROM firsts WHERE n >= 30),
    halves AS (
      SELECT line, n, place, m, side, CASE WHEN side = 0 THEN left(line, m // 2) ELSE right(line, m - m // 2) END AS half
      FROM (SELECT *, unnest([n, n, n - 1, n - 1]) AS m, unnest([0, 1, 0, 1]) AS side FROM long)
    ),
    pairs AS (
      SELECT DISTINCT a.line, string_split(a.line, '') AS x, string_split(b.line, '') AS y
      FROM halves AS a JOIN halves AS b USING (m, side, half)
      WHERE b.place < a.place AND abs(a.n - b.n) <= 1
    ),
    near AS (
      SELECT DISTINCT line FROM pairs
      WHERE len(list_filter(range(1, len(x) + 1), lambda i: x[i] <> y[i])) = 1 AND len(x) = len(y)
        OR len(x) = len(y) + 1 AND len(list_filter(range(1, len(x) + 1), lambda i: x[1:i - 1] || x[i + 1:] = y)) > 0
        OR len(y) = len(x) + 1 AND len(list_filter(range(1, len(y) + 1), lambda i: y[1:i - 1] || y[i + 1:] = x)) > 0
    ),
    marked AS (
      SELECT v.doc_id, v.line_no, f.place = {{'d': v.doc_id, 'l': v.line_no}} AS first, near.line IS NOT NULL AS near
      FROM visible AS v JOIN firsts AS f USING (line) LEFT JOIN near USING (line)
    ),
    kept AS (
      SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.line_no) AS deduped,
        count(m.line_no) AS n_kept
      FROM lines AS l LEFT JOIN (SELECT * FROM marked WHERE first AND NOT near) AS m USING (doc_id, line_no)
      WHERE m.line_no IS NOT NULL OR NOT regexp_matches(l.line, '{SPACED}')
      GROUP BY l.doc_id
    ),
    counts AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (first AND near) AS n_near FROM marked GROUP BY doc_id)
    SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_kept, 0) AS BIGINT) AS n_kept,
      CAST(coalesce(n_near, 0) AS BIGINT) AS n_near,
      CASE WHEN text IS NULL THEN NULL ELSE sha256(coalesce(deduped, '')) END AS deduped_sha256
    FROM docs LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    deduped = line_dedup.without_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return deduped.select("doc_id", "n_lines", "n_kept", "n_near", F.sha2("deduped", 256).alias("deduped_sha256"))


@register("op8_quality_rules")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def license_oracle() -> str:
    templates = ", ".join(f"({i}, '{label}', '{wording}')" for i, (label, wording) in enumerate(licenses.TEMPLATES))
    phrases = ", ".join(f"('{phrase}', '{label}')" for phrase, label in licenses.PHRASES.items())
    return f"""
    WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM documents),
    phrases(phrase, label) AS (VALUES {phrases}),
    templates(template, label, wording) AS (VALUES {templates}),
    split_templates AS (SELECT template, label, list_distinct(string_split(wording, ' ')) AS tw, len(string_split(wording, ' ')) AS span FROM templates),
    wanted AS (SELECT string_split(phrase, ' ') AS pw, label FROM phrases),
    places AS (
      SELECT doc_id, label, p - 1 AS place
      FROM (SELECT doc_id, w, pw, label, unnest(range(1, len(w) - len(pw) + 2)) AS p FROM d, wanted WHERE len(w) >= len(pw))
      WHERE w[p:p + len(pw) - 1] = pw
    ),
    base AS (
      SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
      FROM places GROUP BY doc_id
    ),
    spans AS (SELECT DISTINCT span FROM split_templates),
    blocks AS (SELECT doc_id, span, run, list_distinct(w[run * span + 1:(run + 2) * span]) AS bw
      FROM (SELECT doc_id, w, span, unnest(range(0, (len(w) + span - 1) // span)) AS run FROM d, spans)),
    matches AS (
      SELECT doc_id, span, run, label, len(list_intersect(tw, bw)) AS common, len(tw) AS size FROM blocks JOIN split_templates USING (span)
      WHERE len(list_intersect(tw, bw)) >= ceil(0.8 * len(tw) - 1e-9)
    ),
    more AS (SELECT doc_id, max(CAST(common AS DOUBLE) / size) AS share, count(DISTINCT (span, run)) AS n_blocks FROM matches GROUP BY doc_id),
    named AS (
      SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels
      FROM (SELECT doc_id, label FROM matches UNION SELECT doc_id, label FROM places) GROUP BY doc_id
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
      CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
      CAST(coalesce(n_blocks, 0) AS BIGINT) AS n_blocks,
      CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0) END AS score
    FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id) LEFT JOIN named USING (doc_id)
    """


@register("op5_license_scan", license_oracle())
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_scan(table(spark, folder, "documents"))


@register("op6_odd_sketch_near_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, folder, "documents"), width=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@register("op9_token_files")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    blocks, codes = token_files.write(table(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json"), Scratch(spark))
    return token_files.read(blocks, codes).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@register("op10_language_id")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language_id.predict(docs, language_id.learn(docs)).select("doc_id", "held_out", "lang_pred", "score")


@register("op2_kneser_ney_quality")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    scored = kneser_ney.perplexities(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select("doc_id", "lang", "n_grams", "perplexity", "threshold", "kept")


def quotation_oracle(messages: str) -> str:
    return rf"""
    WITH RECURSIVE source AS ({messages}),
    m AS (SELECT row_number() OVER () AS row, conv_id, turn, role, text, string_split(text, chr(10)) AS ls FROM source),
    tagged AS (
      SELECT row, conv_id, turn, i, line, len(regexp_replace(opening, '[^>]', '', 'g')) AS level, substr(line, len(opening) + 1) AS body
      FROM (SELECT row, conv_id, turn, i, line, regexp_extract(line, '^[ \t]*(?:>[ \t]*)+', 0) AS opening
        FROM (SELECT row, conv_id, turn, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM m))
    ),
    marked AS (
      SELECT *, level < coalesce(lead(level) OVER (PARTITION BY row ORDER BY i), 0)
        AND regexp_matches(body, '^(?:On .+ wrote|Am .+ schrieb.*|Le .+ a écrit|El .+ escribió) ?:[ \t\r]*$') AS attribution
      FROM tagged
    ),
    levels AS (SELECT DISTINCT row, level FROM marked),
    shown AS (
      SELECT l.row, k.conv_id, k.turn, l.level, string_agg(CASE WHEN k.level = l.level AND NOT attribution THEN body ELSE '' END, chr(10) ORDER BY i) AS text
      FROM levels AS l JOIN marked AS k USING (row) GROUP BY ALL
    ),
    paragraphs AS (
      SELECT row, conv_id, turn, level, place, p, list_distinct(list_concat([p],
        list_transform(string_split(raw, chr(10)), lambda x: trim(regexp_replace(lower(x), '\s+', ' ', 'g'))),
        string_split(regexp_replace(p, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)))) AS passages
      FROM (
        SELECT *, trim(regexp_replace(lower(raw), '\s+', ' ', 'g')) AS p
        FROM (SELECT *, unnest(parts) AS raw, unnest(range(0, len(parts))) AS place FROM (SELECT *, regexp_split_to_array(text, '\n[ \t\r\n]*\n') AS parts FROM shown))
      )
    ),
    quotes AS (SELECT * FROM paragraphs WHERE level > 0 AND p <> ''),
    originals AS (
      SELECT conv_id, passage, min(turn) AS original
      FROM (SELECT conv_id, turn, unnest(passages) AS passage FROM paragraphs WHERE level = 0 AND p <> '') GROUP BY ALL
    ),
    linked AS (
      SELECT row, place, conv_id, turn, level, max({{'a': passage = p, 'b': original}}).b AS original
      FROM (SELECT *, unnest(passages) AS passage FROM quotes) JOIN originals USING (conv_id, passage)
      WHERE original < turn AND length(passage) >= 8 GROUP BY row, place, conv_id, turn, level
    ),
    parents AS (
      SELECT conv_id, turn, max(parent) AS parent
      FROM (SELECT conv_id, turn, max({{'a': -level, 'b': original}}).b AS parent FROM linked GROUP BY row, conv_id, turn) GROUP BY ALL
    ),
    up AS (
      SELECT conv_id, turn, parent AS root FROM parents
      UNION ALL SELECT up.conv_id, up.turn, parent FROM up JOIN parents ON up.conv_id = parents.conv_id AND up.root = parents.turn
    ),
    roots AS (SELECT conv_id, turn, min(root) AS root FROM up GROUP BY ALL),
    counts AS (SELECT row, count(*) AS n_quoted FROM quotes GROUP BY row),
    links AS (SELECT row, count(*) AS n_linked FROM linked GROUP BY row),
    own AS (SELECT s.row, CASE WHEN EXISTS (SELECT 1 FROM levels WHERE levels.row = s.row AND levels.level > 0) THEN trim(s.text, ' ' || chr(9) || chr(10) || chr(13)) ELSE m.text END AS text
      FROM shown AS s JOIN m USING (row) WHERE s.level = 0)
    SELECT m.conv_id, row_number() OVER (PARTITION BY m.conv_id ORDER BY coalesce(root, m.turn), m.turn, role, own.text) - 1 AS position,
      m.turn, role, own.text, parent AS reply_to, coalesce(root, m.turn) AS thread, CAST(coalesce(n_quoted, 0) AS BIGINT) AS n_quoted, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked
    FROM m LEFT JOIN own USING (row) LEFT JOIN parents USING (conv_id, turn) LEFT JOIN roots USING (conv_id, turn) LEFT JOIN counts USING (row) LEFT JOIN links USING (row)
    """


@register("op1_quotation_linking", quotation_oracle("SELECT conv_id, turn, role, text FROM conversations"))
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return quotes.reply_ordered(table(spark, folder, "conversations"))


@register(
    "quotation_linking_replies",
    quotation_oracle(
        """
      SELECT c.conv_id, c.turn, c.role, CASE WHEN q.line IS NULL THEN text ELSE 'On Monday A wrote:' || chr(10) || '> ' || q.line || chr(10) || text END AS text
      FROM conversations AS c LEFT JOIN (
        SELECT conv_id, turn, min(string_split(text, chr(10))[1]) AS line FROM conversations WHERE text IS NOT NULL GROUP BY conv_id, turn
      ) AS q ON c.conv_id = q.conv_id AND q.turn = c.turn - 1 - c.turn % 2
    """
    ),
)
def quoting_replies(spark: SparkSession, folder: str) -> DataFrame:
    """The conversations with a quote in every reply: the first line of the message one or two turns before."""
    messages = table(spark, folder, "conversations")
    first_line = F.substring_index("text", "\n", 1)
    lines = messages.where("text IS NOT NULL").groupBy(F.col("conv_id").alias("of"), F.col("turn").alias("at")).agg(F.min(first_line).alias("line"))
    earlier = (F.col("conv_id") == F.col("of")) & (F.col("at") == F.col("turn") - 1 - F.col("turn") % 2)
    quoting = F.concat(F.lit("On Monday A wrote:\n> "), "line", F.lit("\n"), "text")
    replies = messages.join(lines, earlier, "left").select("conv_id", "turn", "role", F.when(F.col("line").isNull(), F.col("text")).otherwise(quoting).alias("text"))
    return quotes.reply_ordered(replies)


@register(
    "op12_source_divergence",
    r"""
    WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    words AS (SELECT row, lang, source, unnest(w) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
    counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
    languages AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
    totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
    groups AS (
      SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v, coalesce(lang_total, 0) AS lang_total
      FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN totals USING (lang, source) LEFT JOIN languages USING (lang)
    ),
    dense AS (
      SELECT lang, source, term, coalesce(n, 0) AS n,
        1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (total + v)::HUGEINT AS p, 1 + 1000000000::HUGEINT * (lang_n + 1) // (lang_total + v)::HUGEINT AS q
      FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)
    ),
    sums AS (
      SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM dense AS a JOIN dense AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    ),
    pairs AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
      FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
    ),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM dense WHERE n > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence(table(spark, folder, "documents"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the rows, by the id's hash, a passage repeats to the end of the text.

    h = crc32(doc_id as text), g = h div 10; where h ends in 0, each word i >= a = g mod n is word a + (i - a) mod p,
    p = 1 + (n - a) div (3 + g mod 8). Rows without an id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = F.filter(F.split("text", SPACE_GAP), lambda w: w != "")
    marked = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, split).alias("words"))
    sized = marked.select("*", F.size("words").alias("n")).select("*", F.when(F.col("n") > 0, F.col("g") % F.col("n")).alias("a"))
    placed = sized.select("*", F.expr("1 + (n - a) div (3 + g % 8)").alias("p"))
    planted = F.expr("array_join(transform(sequence(0, n - 1), i -> element_at(words, cast(if(i < a, i, a + (i - a) % p) + 1 as int))), ' ')")
    return placed.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


@register(
    "op13_periodic_runs",
    rf"""
    WITH RECURSIVE steps(i, k, v) AS (
      SELECT CAST(i AS BIGINT), 0, CAST(i AS BIGINT) FROM range(256) AS r(i)
      UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM steps WHERE k < 8
    ),
    crc_table AS (SELECT i, v FROM steps WHERE k = 8),
    crcs(id, pos, c) AS (
      SELECT DISTINCT CAST(doc_id AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM documents WHERE doc_id IS NOT NULL
      UNION ALL SELECT id, pos + 1, xor(c // 256, v) FROM crcs JOIN crc_table ON i = xor(c, CAST(ascii(substr(id, pos + 1, 1)) AS BIGINT)) % 256 WHERE pos < length(id)
    ),
    hashes AS (SELECT id, xor(c, 4294967295) AS h FROM crcs WHERE pos = length(id)),
    split AS (
      SELECT doc_id, w, len(w) AS n, h, h // 10 AS g FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents)
        LEFT JOIN hashes ON id = CAST(doc_id AS VARCHAR)
    ),
    placed AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM split),
    sized AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed),
    d AS (
      SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM sized
    ),
    grams AS (SELECT doc_id, n, i, list_slice(w, i, i + 5) AS gram FROM (SELECT doc_id, n, w, unnest(range(1, n - 4)) AS i FROM d WHERE n >= 12)),
    twins AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM grams AS a JOIN grams AS b ON a.doc_id = b.doc_id AND a.gram = b.gram AND b.i > a.i AND 2 * (b.i - a.i) <= a.n),
    islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM twins),
    stretches AS (SELECT doc_id, q, min(i) - 1 AS start, max(i) - min(i) + 6 + q AS length FROM islands GROUP BY doc_id, q, island),
    runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(12, 2 * q) GROUP BY doc_id, start, length),
    listed AS (
      SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS shown,
        min({{'l': -length, 's': start, 'q': period}}) AS best
      FROM runs GROUP BY doc_id
    ),
    dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
    words AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, n)) AS i FROM d WHERE n > 0),
    joined AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(-best.l AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period,
      CAST(1000 * -best.l // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(shown, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
    FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN joined USING (doc_id)
    """,
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.periodic_runs(with_planted_runs(table(spark, folder, "documents")))
    shown = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), periodic.longest().alias("best"), F.sha2(shown, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.expr("1000 * best.length div best.period")
    return best.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@register("op11_personal_data")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = pii.personal_data(docs, pii.learn(docs)).select("doc_id", "spans", F.filter("spans", lambda s: s["by"] == "rule").alias("base"))

    def listed(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))

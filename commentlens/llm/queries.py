"""The operators over the given tables, and SQL that checks them where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentlens.llm import alignment, chat, decontaminate, line_dedup, mixing, ngram_join, pii, quality, secret_scan, spelling, substring_dedup, url_filter, warc
from commentlens.llm.common import settle, shared_folder, table, words

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(make: Query) -> Query:
    REGISTRY[make.__name__] = make
    return make


@query
def op1_line_dedup(spark, sf):
    """What is left of every document."""
    kept = line_dedup.drop_recurring_lines(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


@query
def op2_decontaminate(spark, sf):
    """Benchmark items found in documents."""
    hits = decontaminate.contained_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    share = (F.col("n_found") / F.col("n_item")).alias("containment")
    return hits.select("doc_id", "item_id", "n_item", "n_found", share)


@query
def op3_quality_rules(spark, sf):
    """Statistics of every document, and what the base rules and the learned list say."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    statistics = settle(quality.text_statistics(docs).drop("text"))
    rules = quality.learn_from_labels(statistics, table(spark, sf, "labels"))
    return quality.judged(statistics, rules)


_PLAIN_WORDS = (
    "list_filter(regexp_split_to_array(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',"
    " 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]', ' ', 'g'), ' +'), lambda x: x <> '')"
)


def _shingle_sql(name: str, key: str) -> str:
    return f"""{name} AS (
      SELECT {key}, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END AS s
      FROM (SELECT {key}, {_PLAIN_WORDS} AS w FROM {{}}) WHERE len(w) > 0
    )"""


ORACLES["op2_decontaminate"] = f"""
    WITH {_shingle_sql("d", "doc_id").format("documents")}, {_shingle_sql("b", "item_id").format("benchmark")},
    ds AS (SELECT DISTINCT doc_id, unnest(s) AS g FROM d), bs AS (SELECT DISTINCT item_id, unnest(s) AS g FROM b),
    n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY ALL),
    f AS (SELECT doc_id, item_id, count(*) AS n_found FROM ds JOIN bs USING (g) GROUP BY ALL)
    SELECT doc_id, item_id, n_item, n_found, n_found / n_item AS containment
    FROM f JOIN n USING (item_id) WHERE 100 * n_found >= 75 * n_item
"""


@query
def op4_ngram_jaccard_join(spark, sf):
    """Shingle count and component of every document."""
    return ngram_join.jaccard_components(table(spark, sf, "documents"))


ORACLES["op4_ngram_jaccard_join"] = r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
    e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON r.doc_id = e.a)
    SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(root) AS component_id
    FROM r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id
"""


@query
def op5_mix_sources(spark, sf):
    """Words that the mix takes of every document."""
    docs = table(spark, sf, "documents").select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    mixed = mixing.mix_sources(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times_taken")).alias("taken"))


ORACLES["op5_mix_sources"] = r"""
    WITH RECURSIVE d AS (
      SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k FROM documents),
    s AS (
      SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
    w AS (SELECT *, ([5, 2, 1])[((r - 1) % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS most FROM s),
    level AS (
      SELECT 1.5::DOUBLE * (SELECT sum(source_size) FROM w) AS rest, (SELECT sum(w) FROM w) AS free, 0 AS step
      UNION ALL
      SELECT 1.5::DOUBLE * (SELECT sum(source_size) FROM w)
          - (SELECT coalesce(sum(most), 0) FROM w WHERE w.w * level.rest / level.free > most),
        (SELECT sum(w.w) FROM w WHERE w.w * level.rest / level.free <= most), step + 1
      FROM level WHERE step < 50 AND level.free IS NOT NULL),
    settled AS (SELECT rest, free FROM level WHERE free IS NOT NULL ORDER BY step DESC LIMIT 1),
    t AS (SELECT w.*, CASE WHEN w * rest / free > most THEN most ELSE w * rest / free END AS target FROM w, settled),
    c AS (
      SELECT d.*, r, source_size, target, sum(size) OVER (PARTITION BY r ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    e AS (
      SELECT *, ((e * source_size + cum)::DOUBLE / target) AS f FROM c, (VALUES (0), (1)) v(e) WHERE size > 0 AND target > 0),
    u AS (SELECT *, sum(size) OVER (ORDER BY f, r, e, k, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM e),
    n AS (SELECT doc_id, count(*) AS n FROM u WHERE upto <= 1.5 * (SELECT sum(source_size) FROM s) GROUP BY ALL)
    SELECT c.doc_id, size::BIGINT AS size, source_size, target, (size * coalesce(n, 0))::BIGINT AS taken
    FROM c LEFT JOIN n ON c.doc_id = n.doc_id
"""


@query
def op6_substring_dedup(spark, sf):
    """What is left of every document without repeated passages."""
    kept = substring_dedup.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op6_substring_dedup"] = r"""
    WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
    g AS (
      SELECT doc_id, unnest(range(1, greatest(len(w) - 18, 1))) AS i, unnest(list_transform(range(1, greatest(len(w) - 18, 1)),
        lambda k: md5(array_to_string(w[k:k + 19], ' ')))) AS s FROM w),
    r AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
    c AS (SELECT doc_id, list(DISTINCT i + k) AS gone FROM r, range(20) v(k) GROUP BY doc_id),
    k AS (
      SELECT w.doc_id, len(w) AS n, list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT coalesce(list_contains(gone, i), false)), lambda i: w[i]) AS kept
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id)
    SELECT doc_id, n::BIGINT AS n_words, (n - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""


#: A key for trial runs; real ones come from outside.
_TRIAL_KEY = b"not a secret"


@query
def op7_pii_pseudonyms(spark, sf):
    """Every document with pseudonyms for personal data."""
    return pii.pseudonymise(table(spark, sf, "documents").select("doc_id", "text"), _TRIAL_KEY)


@query
def op8_secret_scan(spark, sf):
    """Secrets of every document."""
    found = secret_scan.find_secrets(table(spark, sf, "documents"))
    base = F.filter("secrets", lambda s: s["rule"] < len(secret_scan.BASE_RULES))

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(secret_scan.as_text(base), 256).alias("base_sha256"), secret_scan.as_text(F.col("secrets")).alias("spans"))


@query
def op9_chat_format(spark, sf):
    """Every conversation, read back from the tree of formatted turns."""
    trial = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trial).alias("text"),
    )
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    tree, members = chat.prefix_tree(rows)
    return chat.conversation_digests(settle(tree), members)


ORACLES["op9_chat_format"] = r"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    e AS (SELECT *, len(regexp_extract_all(text, '<\\*(\||/?s>|</?SYS>>)|\[\\*/?INST\]')) AS escapes FROM t)
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(8 + length(role) + 1 + length(text) + escapes + 8)::BIGINT AS formatted_chars
    FROM e GROUP BY conv_id
"""


#: The tables hold no fetch times and no lists. A page is fetched at a time made from its id, within 2023 and 2024; every third
#: host is listed (its domain, itself or a path of it), some are taken off and listed again.
_START, _SPAN = 1_672_531_200, 730 * 86_400


def _captures(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", (F.lit(_START) + F.pmod(F.col("page_id") * 7_919_003, F.lit(_SPAN))).alias("fetched"))


def _entries(pages: DataFrame) -> DataFrame:
    keys = url_filter.url_keys(F.col("url"))
    named = pages.select(keys["host"].alias("host"), keys["path1"].alias("path"), keys["parent1"].alias("parent")).where("host IS NOT NULL")
    code = F.conv(F.substring(F.md5("host"), 1, 8), 16, 10).cast("long")
    hosts = named.groupBy("host").agg(F.min("path").alias("path"), F.min("parent").alias("parent")).withColumn("h", code)
    kind = F.pmod("h", F.lit(9))
    key = F.when(kind == 0, F.coalesce("parent", "host")).when(kind == 3, F.coalesce("path", "host")).when(kind == 6, F.col("host"))
    since = F.lit(_START) + F.pmod("h", F.lit(_SPAN))
    listed = [(0, True), (60, False), (150, True)]
    events = F.array(*[F.struct((since + days * 86_400).alias("at"), F.lit(on).alias("listed")) for days, on in listed])
    used = F.slice(events, F.lit(1), (F.pmod(F.floor(F.col("h") / 9), F.lit(3)) + 1).cast("int"))
    reason = F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("spam")), (F.pmod(F.floor(F.col("h") / 27), F.lit(3)) + 1).cast("int"))
    return hosts.select(key.alias("key"), F.explode(used).alias("e"), reason.alias("reason")).select("key", "e.at", "e.listed", "reason")


@query
def op10_url_filter(spark, sf):
    """Every capture judged by the lists as they were when it was fetched."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    return url_filter.filter_captures(_captures(pages), _entries(pages))


ORACLES["op10_url_filter"] = r"""
    WITH p AS (
      SELECT page_id, url, 1672531200 + (page_id * 7919003) % 63072000 AS fetched,
        nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)(?::[0-9]*)?([^?#]*)', 1)), '.'), '') AS host,
        list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)(?::[0-9]*)?([^?#]*)', 2), '/'), lambda x: x <> '') AS parts
      FROM pages),
    k AS (
      SELECT *, string_split(host, '.') AS l, CASE WHEN len(parts) >= 1 THEN host || '/' || parts[1] END AS path1 FROM p),
    k2 AS (
      SELECT *, CASE WHEN len(l) >= 3 THEN array_to_string(l[2:], '.') END AS parent1,
        CASE WHEN len(l) >= 4 THEN array_to_string(l[3:], '.') END AS parent2 FROM k),
    h AS (
      SELECT host, min(path1) AS path, min(parent1) AS parent, ('0x' || substr(md5(host), 1, 8))::BIGINT AS h
      FROM k2 WHERE host IS NOT NULL GROUP BY host),
    e AS (
      SELECT CASE h % 9 WHEN 0 THEN coalesce(parent, host) WHEN 3 THEN coalesce(path, host) WHEN 6 THEN host END AS key,
        1672531200 + h % 63072000 + d * 86400 AS ts, d <> 60 AS listed,
        (['adult', 'malware', 'spam'])[((h // 27) % 3 + 1)::INT] AS reason
      FROM h, (VALUES (0, 1), (60, 2), (150, 3)) v(d, n) WHERE n <= (h // 9) % 3 + 1),
    o AS (
      SELECT key, ts, listed, reason FROM e WHERE key IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY key, ts ORDER BY listed DESC, reason) = 1),
    i AS (SELECT key, ts AS start, lead(ts) OVER (PARTITION BY key ORDER BY ts) AS until, listed, reason FROM o),
    c AS (
      SELECT page_id, n, key FROM (
        SELECT page_id, unnest([1, 2, 3, 4]) AS n, unnest([path1, host, parent1, parent2]) AS key FROM k2) WHERE key IS NOT NULL),
    m AS (
      SELECT p.page_id, c.key, i.start, i.reason, row_number() OVER (PARTITION BY p.page_id ORDER BY c.n) AS r
      FROM p JOIN c USING (page_id) JOIN i USING (key)
      WHERE listed AND start <= fetched AND (until IS NULL OR fetched < until))
    SELECT p.page_id, url, fetched, m.key IS NOT NULL AS blocked, m.key AS matched_key, m.start AS listed_since, m.reason
    FROM p LEFT JOIN m ON p.page_id = m.page_id AND r = 1
"""

#: Where the public tokenizers' files are.
TOKENIZERS = "/opt/tokenizers"


@query
def op11_token_alignment(spark, sf):
    """How two tokenizers' tokens cover every document."""
    return alignment.align(table(spark, sf, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")


@query
def op12_warc_records(spark, sf):
    """Every page written to an archive and read back: its payload, and which record holds it."""
    archives = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf, "pages"), archives)
    captures = settle(
        warc.assemble(warc.read_records(spark, archives, payload=False)).select(
            "id", F.expr("try_cast(metadata.fields['capture-key'] AS bigint)").alias("page_id"),
            "capture.type", "capture.digest", "capture.payload_bytes", "capture.refers_to",
        )
    )
    kept = captures.select(F.col("id").alias("refers_to"), F.col("page_id").alias("kept_page"), F.col("payload_bytes").alias("kept_bytes"))
    return captures.join(kept, "refers_to", "left").select(
        "page_id", F.coalesce("kept_bytes", "payload_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("kept_page").alias("refers_to"),
    )


ORACLES["op12_warc_records"] = r"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
    k AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS kept FROM p)
    SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
      array_to_string(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
      CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to
    FROM k
"""


#: Every so many runs, by a checksum of document and run, loses a letter: the planted slips of the pen.
_SLIP = 199


@query
def op13_spelling_variants(spark, sf):
    """Words of the documents with the spelling that they are a variant of."""
    counted = spelling.word_counts(table(spark, sf, "documents"), slip_every=_SLIP)
    return spelling.variant_forms(counted.where((F.length("word") >= 6) & (F.col("n") >= 5)))


ORACLES["op13_spelling_variants"] = r"""
    WITH t AS (
      SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
      FROM range(256) r(i)),
    r AS (
      SELECT doc_id, run, count(*) AS n FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run
        FROM documents) GROUP BY ALL),
    x AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM r),
    b AS (SELECT run, n, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) AS b FROM x),
    h AS (SELECT run, n, xor(list_reduce(b, lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), 4294967295), 4294967295) AS h FROM b, t),
    w AS (
      SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
      FROM h GROUP BY ALL),
    v AS MATERIALIZED (SELECT * FROM w WHERE length(word) >= 6 AND n >= 5),
    c AS MATERIALIZED (SELECT DISTINCT word, length(word) AS l, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut
      FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
    p AS (
      SELECT a.word AS a, b.word AS b FROM c a JOIN c b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
      UNION SELECT c.word, v.word FROM c JOIN v ON c.cut = v.word
      UNION SELECT v.word, c.word FROM c JOIN v ON c.cut = v.word),
    g AS (
      SELECT a AS word, count(*) AS n_near, max(v.n) AS top, arg_min(b, (-v.n, b)) AS best FROM p JOIN v ON b = v.word GROUP BY a),
    f AS (
      SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * v.n THEN best END AS form, CASE WHEN top >= 5 * v.n THEN top END AS form_n
      FROM v LEFT JOIN g ON v.word = g.word),
    s AS (
      WITH RECURSIVE u AS (SELECT word, word AS root FROM f UNION ALL SELECT u.word, f.form FROM u JOIN f ON u.root = f.word WHERE f.form IS NOT NULL)
      SELECT u.word, u.root FROM u JOIN f ON u.root = f.word WHERE f.form IS NULL)
    SELECT f.word, form, root, n, n_near, form_n FROM f JOIN s ON f.word = s.word
"""

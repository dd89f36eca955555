"""The registered queries of this subpackage: thin digests over the operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from hourloom.llm import chat, collocation, decontaminate, language, lattice, near_dup, pii, quality, repair, subword, topk, toxicity, url_filter
from hourloom.llm.training import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


def oracle(sql: str):
    def add(run):
        ORACLES[run.__name__] = sql.strip()
        return run

    return add


def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_sentencepiece(spark, sf_dir):
    coded = subword.encode_texts(table(spark, sf_dir, "documents"), vocabulary())
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op7_near_duplicates(spark, sf_dir):
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "linked")


def judged(scores: DataFrame, threshold: float) -> DataFrame:
    held_out = (fold("doc_id", 4) == 2).alias("held_out")
    return scores.select("doc_id", held_out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2)


@query
def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, training_labels(spark, sf_dir))
    return judged(toxicity.score_texts(docs, model), toxicity.THRESHOLD)


@query
def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, training_labels(spark, sf_dir))
    return judged(quality.score_texts(docs, model), quality.THRESHOLD)


PROBE = "</s>[INST] ok [/INST]"


@oracle(
    r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role IS NULL AS no_role, text IS NULL AS no_text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', false, false
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', false, false
), escaped AS (
  SELECT *, length(regexp_replace(text, '(\\|<s>|</s>|\[INST\]|\[/INST\]|\[SYS\]|\[/SYS\]|\[ROLE |\[/ROLE\]|<\|image |<\|audio |<\|document )', '#\1', 'g')) AS chars,
    CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 5
      ELSE 17 + length(replace(regexp_replace(role, '(\\|<s>|</s>|\[INST\]|\[/INST\]|\[SYS\]|\[/SYS\]|\[ROLE |\[/ROLE\]|<\|image |<\|audio |<\|document )', '#\1', 'g'), ']', '#]')) END AS marks
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, no_role DESC, role, no_text DESC, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, no_role DESC, role, no_text DESC, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(chars + marks))::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
)
@query
def op4_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    return chat.read_back(chat.format_turns(turns.unionByName(probe)))


@oracle(
    r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut
), named AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM parts
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    CASE WHEN starts_with(host, 'm.') THEN 'm.* *'
      WHEN starts_with(host, 'ads.') THEN 'ads.* *'
      WHEN contains(host, 'casino') THEN '*casino* *'
      WHEN contains(path, '/login') THEN '* */login*'
      WHEN contains(path, '/ads/') THEN '* */ads/*'
      WHEN ends_with(path, '.exe') THEN '* *.exe'
      WHEN ends_with(path, '.zip') THEN '* *.zip' END AS pattern
  FROM named
)
SELECT page_id, host, path, rule, pattern,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL OR pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
)
@query
def op6_url_filter(spark, sf_dir):
    return url_filter.judge_pages(table(spark, sf_dir, "pages"))


@oracle(
    """
WITH usable AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
)
@query
def op9_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


@query
def op5_lm_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return lattice.score_texts(docs, lattice.Lattice.from_model(vocabulary()), fold("doc_id", 5) == 1)


def spans_text(column: str):
    return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def kind_count(kind: str):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


@query
def op1_personal_data(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = pii.find_personal_data(docs, pii.train(docs))
    return found.select(
        "doc_id", *[kind_count(k) for k in pii.KINDS], F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans")
    )


# crc32 has no function there: the bits of the register are folded in byte by byte.
_CRC = """
  xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(place, '')]), lambda crc, byte:
    list_reduce(list_prepend(xor(crc, byte), [1::BIGINT, 1, 1, 1, 1, 1, 1, 1]), lambda r, one: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)
  ), 4294967295)
"""


@oracle(
    r"""
WITH RECURSIVE placed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations
), faulty AS (
  SELECT *, CRC % 20 AS fault FROM placed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
  FROM faulty WHERE fault <> 0
), seen AS (
  SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n, lag(left(role, 1)) OVER w AS before,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS shown
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), sha256(text), copy)
), judged AS (
  SELECT *, left(role, 1) AS i, CASE WHEN shown = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen
), priced AS (
  SELECT *, fault IN ('blank', 'duplicate') AS gone, (fault = 'truncated')::BIGINT AS cut FROM judged
), back AS (
  SELECT conv_id, max(pos) + 1 AS pos, {c: 0::BIGINT, a: '', o: []::VARCHAR[]} AS b0, {c: 4::BIGINT, a: 'II', o: ['user:', 'assistant:']} AS b1,
    {c: 2::BIGINT, a: 'I', o: ['assistant:']} AS b2, {c: 0::BIGINT, a: '', o: []::VARCHAR[]} AS b3
  FROM priced GROUP BY conv_id
  UNION ALL
  SELECT conv_id, pos, r0,
    list_min([r1, {c: r2.c + 2, a: 'I' || r2.a, o: list_prepend('user:', r2.o)}, {c: r3.c + 4, a: 'II' || r3.a, o: list_prepend('user:', list_prepend('assistant:', r3.o))}]),
    list_min([r2, {c: r3.c + 2, a: 'I' || r3.a, o: list_prepend('assistant:', r3.o)}]),
    list_min([r3, {c: r2.c + 2, a: 'I' || r2.a, o: list_prepend('user:', r2.o)}])
  FROM (
    SELECT conv_id, pos,
      list_min([q0, {c: q2.c + 2, a: 'I' || q2.a, o: list_prepend('user:', q2.o)}, {c: q3.c + 4, a: 'II' || q3.a, o: list_prepend('user:', list_prepend('assistant:', q3.o))}]) AS r0,
      q1 AS r1, q2 AS r2, q3 AS r3
    FROM (
      SELECT b.conv_id, p.pos,
        list_min(list_filter([{c: b0.c + 3, a: 'D' || b0.a, o: b0.o},
          CASE WHEN NOT gone THEN {c: b2.c + 2 + cut, a: 'R' || b2.a, o: list_prepend('user:' || text, b2.o)} END,
          CASE WHEN NOT gone AND i = 's' THEN {c: b1.c + cut, a: 'K' || b1.a, o: list_prepend(role || ':' || text, b1.o)} END,
          CASE WHEN NOT gone AND i = 'u' THEN {c: b2.c + cut, a: 'K' || b2.a, o: list_prepend(role || ':' || text, b2.o)} END], lambda x: x IS NOT NULL)) AS q0,
        list_min(list_filter([{c: b1.c + 3, a: 'D' || b1.a, o: b1.o},
          CASE WHEN NOT gone THEN {c: b2.c + 2 + cut, a: 'R' || b2.a, o: list_prepend('user:' || text, b2.o)} END,
          CASE WHEN NOT gone AND i = 'u' THEN {c: b2.c + cut, a: 'K' || b2.a, o: list_prepend(role || ':' || text, b2.o)} END], lambda x: x IS NOT NULL)) AS q1,
        list_min(list_filter([{c: b2.c + 3, a: 'D' || b2.a, o: b2.o},
          CASE WHEN NOT gone THEN {c: b3.c + 2 + cut, a: 'R' || b3.a, o: list_prepend('assistant:' || text, b3.o)} END,
          CASE WHEN NOT gone AND i = 'a' THEN {c: b3.c + cut, a: 'K' || b3.a, o: list_prepend(role || ':' || text, b3.o)} END], lambda x: x IS NOT NULL)) AS q2,
        list_min(list_filter([{c: b3.c + 3, a: 'D' || b3.a, o: b3.o},
          CASE WHEN NOT gone THEN {c: b2.c + 2 + cut, a: 'R' || b2.a, o: list_prepend('user:' || text, b2.o)} END,
          CASE WHEN NOT gone AND i = 'u' THEN {c: b2.c + cut, a: 'K' || b2.a, o: list_prepend(role || ':' || text, b2.o)} END], lambda x: x IS NOT NULL)) AS q3
      FROM back b JOIN priced p ON p.conv_id IS NOT DISTINCT FROM b.conv_id AND p.pos = b.pos - 1
    )
  )
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pos > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM priced GROUP BY conv_id
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(b.b0.c, 0) AS cost, coalesce(b.b0.a, '') AS audit, sha256(coalesce(array_to_string(b.b0.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN back b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.pos = 1
""".replace("CRC", _CRC)
)
@query
def op11_conversation_repair(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return repair.repair(repair.structure_rows(repair.damage(turns), copies="copies"), turns).drop("chunks")


@oracle(
    r"""
WITH pieces AS (
  SELECT lang, unnest(pieces) AS piece FROM (
    SELECT coalesce(lang, 'und') AS lang,
      regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents)
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
), counted AS (
  SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
), sizes AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang
), longer AS (
  SELECT lang, phrase, max(f) AS most FROM (
    SELECT lang, f, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (
      SELECT lang, f, w, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT lang, f, k, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS m FROM counted WHERE k > 2))
  ) GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, cut, array_to_string(string_split(c.phrase, ' ')[1:cut], ' ') AS head, array_to_string(string_split(c.phrase, ' ')[cut + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM counted WHERE k > 1) c LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * c.f
), scored AS (
  SELECT cuts.lang, cuts.phrase, a, h.f AS l, t.f AS r, (2000000 * a) // (h.f + t.f) AS score, cut
  FROM cuts JOIN counted h ON h.lang = cuts.lang AND h.phrase = head JOIN counted t ON t.lang = cuts.lang AND t.phrase = rest
), weakest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM scored
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest WHERE place = 1
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
)
@query
def op12_phrase_collocations(spark, sf_dir):
    return collocation.collocations(collocation.count_phrases(table(spark, sf_dir, "documents")))


@query
def op13_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs, fold("doc_id", 5) != 0))
    return found.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

"""The llm operators on the test tables."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.text import LOOK_ALIKE
from vellum.llm import encoding, forms, leak, mix, overlap, spans, split
from vellum.plans.oracles import form
from vellum.session import ensure_checkpoint_dir, table


def folded_words(column: str) -> str:
    """SQL for words without case and accents, as a list."""
    return f"regexp_extract_all(replace(strip_accents(lower({form(column)})), 'đ', 'd'), '[\\p{{L}}\\p{{N}}]+')"


#: Vocabulary file of a public tokenizer.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "legal_units").select(F.lit("unit").alias("kind"), F.col("unit_id").alias("key"), "text")
    candidates = table(spark, d, "candidates").select(F.lit("candidate").alias("kind"), F.col("candidate_id").alias("key"), "text")
    return split.split_texts(units.unionByName(candidates), table(spark, d, "piece_limits"), "kind", "key", "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pieces(spark, d).where("pieces > 1").select("item_kind", "item_key").distinct()


def p2_files(spark: SparkSession, d: str) -> DataFrame:
    """All unit texts as large files in the shared folder, cut by byte ranges under the units' limit: their pieces."""
    limit = table(spark, d, "piece_limits").where("item_kind = 'unit'").first()
    texts = table(spark, d, "legal_units").where("text is not null").select(F.regexp_replace("text", r"\r\n?", "\n").alias("value"))
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/texts-{uuid4().hex}"
    texts.write.text(folder)
    pieces = split.split_files(spark, folder, limit["max_chars"], limit["overlap_chars"], 4 << 20)
    return pieces.select("begin", "end", "cut", "text")


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(table(spark, d, "gold_questions"), "question_id", "question", "split", "gold_unit_ids")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select(F.least("train_id", "eval_id").alias("question_a"), F.greatest("train_id", "eval_id").alias("question_b")).distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(_overlaps(spark, d), table(spark, d, "gold_questions"), "question_id", "split", "source")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "legal_units").select(F.lit("legal_units").alias("table_name"), F.col("unit_id").alias("key"), "text")
    questions = table(spark, d, "gold_questions").select(F.lit("gold_questions").alias("table_name"), F.col("question_id").alias("key"), F.col("question").alias("text"))
    records = table(spark, d, "portal_records").where("try_parse_json(payload) is not null")
    records = records.select(F.lit("portal_records").alias("table_name"), F.col("record_id").cast("string").alias("key"), F.get_json_object("payload", "$.data.docName").alias("text"))
    return units.unionByName(questions).unionByName(records)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_kinds(spark, d).select("table_name", "record_key").distinct()


def p6_kinds(spark: SparkSession, d: str) -> DataFrame:
    parts = {name: _texts(spark, d).where(F.col("table_name") == name) for name in ("legal_units", "gold_questions", "portal_records")}
    found = [forms.odd_texts(df, "key", "text").select(F.lit(name).alias("table_name"), "record_key", F.array_join("kinds", ",").alias("kinds"), "canonical") for name, df in parts.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


def p6_same(spark: SparkSession, d: str) -> DataFrame:
    """Unit texts that are equal in the one form, by hash: how many units and how many different written forms."""
    units = forms.canonical_texts(table(spark, d, "legal_units").select("unit_id", "text"), "text", "form")
    per_form = units.groupBy(F.sha2("form", 256).alias("form_sha256")).agg(F.count_distinct("unit_id").alias("units"), F.count_distinct(F.xxhash64("text")).alias("spellings"))
    return per_form.where("spellings > 1")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix(table(spark, d, "documents"), "doc_id", "text", "source", table(spark, d, "mix_targets"), VOCABULARY)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.shares(p8_mix(spark, d), table(spark, d, "mix_targets"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = spans.shared_pairs(table(spark, d, "legal_units"), "unit_id", "text", 150)
    return pairs.select(F.col("id_a").alias("unit_a"), F.col("id_b").alias("unit_b"))


def p4_share(spark: SparkSession, d: str) -> DataFrame:
    share = spans.shared_share(table(spark, d, "legal_units"), "unit_id", "text", 150)
    evidence = table(spark, d, "relations").select(F.col("evidence_unit_id").alias("id")).distinct().withColumn("is_evidence", F.lit(True))
    return share.join(evidence, "id", "left").select(F.col("id").alias("unit_id"), "chars", "shared_chars", "share", F.coalesce("is_evidence", F.lit(False)).alias("is_evidence"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.contained_items(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "passage", 25)


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return leak.leak_report(p7_found(spark, d), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restore_encoding(table(spark, d, "documents"), "doc_id", "text", "lang").select("doc_id").distinct()


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restore_encoding(table(spark, d, "documents"), "doc_id", "text", "lang").select("doc_id", F.array_join("chains", ",").alias("chains"), "changed_words", "restored")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found, "p2_pieces": p2_pieces, "p2_files": p2_files,
    "p3_found": p3_found, "p3_report": p3_report,
    "p4_found": p4_found, "p4_share": p4_share,
    "p6_found": p6_found, "p6_kinds": p6_kinds, "p6_same": p6_same,
    "p7_found": p7_found, "p7_report": p7_report,
    "p8_mix": p8_mix, "p8_shares": p8_shares,
    "p9_found": p9_found, "p9_restored": p9_restored,
}
_SIZED = "(select 'unit' item_kind, unit_id item_key, length(text) n from legal_units union all select 'candidate', candidate_id, length(text) from candidates)"
_ALIKE = "".join(LOOK_ALIKE)
#: Text that holds an odd form: full width, invisible, another space, an accent that composes, or a letter of another script beside Latin ones or in a word of look-alikes only.
_ODD = f"""(regexp_matches(t, '[\\x{{ff01}}-\\x{{ff5e}}\\x{{ffe0}}-\\x{{ffe6}}\\x{{ad}}\\x{{34f}}\\x{{61c}}\\x{{180e}}\\x{{200b}}-\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{2060}}-\\x{{206f}}\\x{{feff}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]')
    or regexp_matches(t, '\\p{{L}}\\p{{Mn}}') and nfc_normalize(t) <> t
    or regexp_matches(t, '(^|[^\\p{{L}}\\p{{Mn}}])[ðɖ]|[ÐƉ]|\\p{{Latin}}\\p{{Mn}}*[\\p{{Cyrillic}}\\p{{Greek}}]|[\\p{{Cyrillic}}\\p{{Greek}}]\\p{{Mn}}*\\p{{Latin}}|(^|[^\\p{{L}}\\p{{Mn}}])([{_ALIKE}]\\p{{Mn}}*)+($|[^\\p{{L}}\\p{{Mn}}])'))"""
_ODD_TEXTS = """(select 'legal_units' table_name, unit_id record_key, text t from legal_units union all select 'gold_questions', question_id, question from gold_questions
    union all select 'portal_records', cast(record_id as varchar), json_extract_string(payload, '$.data.docName') from portal_records where json_valid(payload))"""
_PAIRS = f"""with q as (select distinct question_id, lower(trim(split)) split, gold_unit_ids, {folded_words("question")} ws from gold_questions where question is not null),
    n as (select question_id, split, unnest(gold_unit_ids) u, len(ws) n from q where len(ws) > 0),
    w as (select question_id, word, count(*) c from (select question_id, unnest(ws) word from q) group by 1, 2),
    p as (select distinct a.question_id t, b.question_id e, b.split, greatest(a.n, b.n) n from n a join n b using (u) where a.split = 'train' and b.split in ('dev', 'test')),
    f as (select t, e, p.split, n, sum(least(a.c, b.c)) both_have from p join w a on a.question_id = t join w b on b.question_id = e and b.word = a.word group by all)"""
_LEAKS = f"""with d as (select doc_id, {folded_words("text")} ws from documents where text is not null), i as (select item_id, {folded_words("passage")} ws from eval_items where passage is not null),
    dg as (select doc_id, md5(array_to_string(ws[k:k + 24], ' ')) g from (select doc_id, ws, unnest(range(1, len(ws) - 23)) k from d where len(ws) >= 25)),
    ig as (select item_id, md5(array_to_string(ws[k:k + 24], ' ')) g from (select item_id, ws, unnest(range(1, len(ws) - 23)) k from i where len(ws) >= 25)),
    found as (select distinct doc_id, item_id from dg join ig using (g))"""
ORACLES: dict[str, str] = {
    "p2_found": f"select distinct item_kind, item_key from {_SIZED} join piece_limits using (item_kind) where n > max_chars and item_key is not null",
    # every run of 150 characters, by hash
    "p4_found": """with u as (select unit_id, any_value(text) text from legal_units where length(text) >= 150 group by 1),
        g as (select distinct unit_id, md5(substring(text, i, 150)) h from (select unit_id, text, unnest(range(1, length(text) - 148)) i from u)),
        k as (select h from g group by 1 having count(*) > 1)
        select distinct a.unit_id unit_a, b.unit_id unit_b from g a join k using (h) join g b using (h) where a.unit_id < b.unit_id""",
    # the same, as places: a unit's shared characters are the union of its shared runs
    "p4_share": """with u as (select unit_id, any_value(text) text from legal_units where length(text) >= 150 group by 1),
        g as (select unit_id, i, md5(substring(text, i, 150)) h from (select unit_id, text, unnest(range(1, length(text) - 148)) i from u)),
        s as (select unit_id, i, h from g where h in (select h from g group by 1 having count(distinct unit_id) > 1)),
        c as (select unit_id, sum(least(150, coalesce(next - i, 150))) shared from (select unit_id, i, lead(i) over (partition by unit_id order by i) next from s) group by 1),
        n as (select unit_id, max(coalesce(length(text), 0)) chars from legal_units where unit_id is not null group by 1)
        select unit_id, chars, cast(coalesce(shared, 0) as bigint) shared_chars, case when chars > 0 then round(coalesce(shared, 0) / chars, 6) else 0.0::double end share,
            unit_id in (select evidence_unit_id from relations where evidence_unit_id is not null) is_evidence from n left join c using (unit_id)""",
    "p3_found": _PAIRS + " select distinct least(t, e) question_a, greatest(t, e) question_b from f where 5 * both_have >= 4 * n",
    "p3_report": _PAIRS + """, h as (select e question_id, split, count(distinct t) pairs from f where 5 * both_have >= 4 * n group by 1, 2), b as (select distinct question_id, lower(trim(split)) split, source from gold_questions)
        select split, source, count(*) questions, count(pairs) overlapping, cast(coalesce(sum(pairs), 0) as bigint) pairs from b left join h using (question_id, split) where split in ('dev', 'test') group by 1, 2""",
    "p6_found": f"select distinct table_name, record_key from {_ODD_TEXTS} where record_key is not null and {_ODD}",
    "p7_found": _LEAKS + " select doc_id, item_id from found",
    "p7_report": _LEAKS + ", h as (select item_id, count(*) hits from found group by 1) select split, source, count(*) items, count(hits) leaked_items, cast(coalesce(sum(hits), 0) as bigint) hits from eval_items left join h using (item_id) group by 1, 2",
}

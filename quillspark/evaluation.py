"""Registered queries of reports, datasets, stored rows and readers over the given tables, and the same in DuckDB's SQL."""

from pyspark.sql import functions as F

from .functions import text as T
from .operators import datasets as N
from .operators import layout as L
from .operators import metrics as M
from .operators import reports as P
from .operators import search as S
from .operators import store as D
from .operators import training as G
from .operators.queries import parse_queries
from .plans.corpus import SQL as CORPUS
from .plans.corpus import read, rendered
from .plans.process import process
from .queries import _TOP, _docs, _graded, _stored, query
from .sources import files as R

CLASSES = ["invoice", "receipt", "purchase_order"]

# Predictions made from the documents' ids and lengths, with the classes of their labels as gold.
_J = """j0 as (select d.doc_id, d.text, d.lang, d.n_chars, ['invoice', 'receipt', 'purchase_order'][1 + (quality + 2 * toxic + d.doc_id // 5) % 3] gold, ['invoice', 'receipt', 'purchase_order'][1 + (quality + d.doc_id // 3) % 3] raw,
  case when d.doc_id % 4 = 0 then ['invoice', 'receipt', 'purchase_order'][1 + (d.doc_id // 5) % 3] end heuristic, d.doc_id % 11 <> 0 extracted from documents d join labels l using (doc_id)),
j1 as (select *, case when not extracted then 'EXTRACTION_FAILED' else coalesce(heuristic, raw) end production, case when extracted and heuristic is null then (n_chars % 100) / 100.0 end confidence from j0), j as (select *, production = gold correct from j1)"""


def judged(spark, d):
    name = lambda i: F.get(F.array(*map(F.lit, CLASSES)), (i % 3).cast("int"))
    fifth = F.floor(F.col("doc_id") / 5)
    rows = _docs(spark, d).join(read(spark, d, "labels"), "doc_id").select(
        "doc_id", "text", "lang", "n_chars", name(F.col("quality") + 2 * F.col("toxic") + fifth).alias("gold"), name(F.col("quality") + F.floor(F.col("doc_id") / 3)).alias("raw"),
        F.when(F.col("doc_id") % 4 == 0, name(fifth)).alias("heuristic"), (F.col("doc_id") % 11 != 0).alias("extracted"),
    )
    rows = rows.withColumns({"production": F.when(~F.col("extracted"), F.lit(P.FAILED)).otherwise(F.coalesce("heuristic", "raw")), "confidence": F.when(F.col("extracted") & F.col("heuristic").isNull(), (F.col("n_chars") % 100) / 100)})
    return rows.withColumn("correct", F.col("production") == F.col("gold"))


_PRF = "coalesce(tp / nullif(tp + fp, 0), 0) p, coalesce(tp / nullif(tp + fn, 0), 0) r"
_CLASS_SUMS = "count(*) filter (where gold = class and pred = class) tp, count(*) filter (where gold <> class and pred = class) fp, count(*) filter (where gold = class and pred <> class) fn, count(*) filter (where gold = class) support"
_SUMMARY = "round(sum(tp) / sum(support), 4) AS accuracy, round(avg(p4), 4) AS macro_precision, round(avg(r4), 4) AS macro_recall, round(avg(f4), 4) AS macro_f1, round(sum(p4 * support) / sum(support), 4) AS weighted_precision, round(sum(r4 * support) / sum(support), 4) AS weighted_recall, round(sum(f4 * support) / sum(support), 4) AS weighted_f1"
_ROUNDED = "round(p, 4) p4, round(r, 4) r4, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) f4"


@query("a3_summary", f"with {_J}, c as (select gold class from j union select production from j), m as (select class, {_CLASS_SUMS} from (select gold, production pred from j), c group by class), x as (select *, {_PRF} from m), y as (select *, {_ROUNDED} from x) select {_SUMMARY} from y")
def a3(spark, d):
    return M.summary_metrics(M.class_metrics(judged(spark, d), "gold", "production"))


@query("a4_populations", f"with {_J}, c as (select unnest(['invoice', 'receipt', 'purchase_order']) class), p as (select 'all' population, * from j union all select 'extracted', * from j where extracted), s as (select population, 'production' system, gold, production pred from p union all select population, 'raw', gold, raw from p), m as (select population, system, class, {_CLASS_SUMS} from s, c group by all), x as (select *, {_PRF} from m), y as (select *, {_ROUNDED} from x) select population, system, {_SUMMARY} from y group by all")
def a4(spark, d):
    return P.population_metrics(judged(spark, d), CLASSES)


@query("a5_confusion_totals", f"""with {_J}, t as (select gold, count(*) filter (where production = 'invoice') a, count(*) filter (where production = 'receipt') b, count(*) filter (where production = 'purchase_order') c, count(*) filter (where production = 'EXTRACTION_FAILED') f, count(*) n from j group by gold) select gold, a AS invoice, b AS receipt, c AS purchase_order, f AS "EXTRACTION_FAILED", n AS total from t union all select 'total_predicted', cast(sum(a) as bigint), cast(sum(b) as bigint), cast(sum(c) as bigint), cast(sum(f) as bigint), cast(sum(n) as bigint) from t""")
def a5(spark, d):
    return P.confusion_totals(M.confusion(judged(spark, d), CLASSES, "gold", "production"))


@query("a7_confidence", f"with {_J} select round(avg(confidence) filter (where correct), 4) AS mean_correct, round(avg(confidence) filter (where not correct), 4) AS mean_incorrect, round(min(confidence) filter (where correct), 4) AS min_correct, round(max(confidence) filter (where not correct), 4) AS max_incorrect from (select correct, cast(confidence as double) confidence from j)")
def a7(spark, d):
    return P.confidence_statistics(judged(spark, d))


@query("a8_heuristic_effect", f"with {_J} select count(heuristic) AS triggered, count(*) filter (where heuristic is not null and heuristic <> raw) AS diverged from j")
def a8(spark, d):
    return P.heuristic_effect(judged(spark, d))


@query("a9_error_causes", f"with {_J} select case when not extracted or length(text) < 10 then 'PROCESSING_FAILURE' when regexp_matches(lower(text), '{'|'.join(P.FOREIGN_WORDS)}') then 'CROSS_LINGUAL_VOCABULARY' else 'CLASSIFIER_GENERALIZATION' end AS cause, count(*) AS n from j where gold = 'receipt' and not correct group by 1")
def a9(spark, d):
    return P.error_causes(judged(spark, d).where("gold = 'receipt' and not correct"))


@query("a24_warning_effect", f"with {_J} select count(*) filter (where not correct and n_chars < 600) AS wrong_warned, count(*) filter (where not correct and n_chars >= 600) AS wrong_not_warned, count(*) filter (where correct and n_chars < 600) AS right_warned from j")
def a24(spark, d):
    return P.warning_effect(judged(spark, d).withColumn("warned", F.col("n_chars") < 600))


@query("a23_detection", f"""with {_J}, s as (select *, case when not extracted then 'unreadable' when length(text) < 40 then 'empty' else 'ok' end status from j where gold = 'invoice' and cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 4) as bigint) < 32768) select count(*) AS sampled, count(*) filter (where status = 'ok') AS read, count(*) filter (where status = 'unreadable') AS unreadable, count(*) filter (where status = 'empty') AS empty, count(*) filter (where status = 'ok' and production = 'invoice') AS detected, round(count(*) filter (where status = 'ok' and production = 'invoice') / count(*) filter (where status = 'ok'), 4) AS rate from s""")
def a23(spark, d):
    status = F.when(~F.col("extracted"), F.lit("unreadable")).when(F.length("text") < 40, F.lit("empty")).otherwise(F.lit("ok"))
    return P.detection_rate(judged(spark, d).where("gold = 'invoice'").withColumn("status", status), "invoice", 0.5, "doc_id", pred="production")


@query("p24_error_samples", f"with {_J}, s as (select gold, row_number() over (partition by gold order by doc_id) sample, doc_id, substr(text, 1, 180) error from j where not correct and text is not null) select gold, doc_id, cast(sample as integer) AS sample, md5(error) AS error_md5 from s where sample <= 3")
def p24(spark, d):
    wrong = judged(spark, d).where("not correct").select("gold", "doc_id", F.col("text").alias("error"))
    return P.error_samples(wrong, ["gold"], "doc_id").select("gold", "doc_id", "sample", F.md5("error").alias("error_md5"))


@query("m8_raw_and_production", f"with {_J} select doc_id, raw = gold AS raw_correct, production = gold AS production_correct from j")
def m8(spark, d):
    return P.raw_and_production(judged(spark, d)).select("doc_id", "raw_correct", "production_correct")


@query("m5_compared_models", f"""with {_J}, c as (select unnest(['invoice', 'receipt', 'purchase_order']) class), s as (select 'production' system, gold, production pred from j union all select 'raw', gold, raw from j), m as (select system, class, {_CLASS_SUMS} from s, c group by all), x as (select *, {_PRF} from m), y as (select *, {_ROUNDED} from x), z as (select system, {_SUMMARY} from y group by all) select round(b.accuracy - a.accuracy, 4) AS delta_accuracy, round(b.macro_f1 - a.macro_f1, 4) AS delta_macro_f1, case when b.macro_f1 - a.macro_f1 > 1e-4 then 'improved' when b.macro_f1 - a.macro_f1 < -1e-4 then 'reduced' else 'matched' end AS outcome from z a, z b where a.system = 'raw' and b.system = 'production'""")
def m5(spark, d):
    both = P.population_metrics(judged(spark, d), CLASSES).where("population = 'all'")
    return P.compared_models(both.where("system = 'raw'"), both.where("system = 'production'"))


@query("a10_extraction_scores", f"""with {CORPUS}, f as (select doc_id, gold_type, unnest(['invoice_number', 'date', 'amount', 'supplier']) field from corpus), r as (select *, case when field = 'supplier' and doc_id % 7 = 0 then 'AMBIGUOUS' when field = 'date' and doc_id % 11 = 0 then 'NOT_PRESENT' else 'PRESENT' end status, not (field = 'amount' and doc_id % 9 = 0) good from f),
l as (select 'all' slice, 'all' value, * from r union all select 'field', field, * from r union all select 'type', gold_type, * from r), c as (select slice, value, count(*) filter (where status = 'PRESENT') tp, count(*) filter (where status = 'NOT_PRESENT') fp, cast(0 as bigint) fn, count(*) filter (where status = 'PRESENT') support, count(*) filter (where status = 'NOT_PRESENT') not_present, count(*) filter (where status = 'AMBIGUOUS') ambiguous, count(*) filter (where status = 'PRESENT' and good) exact from l group by all), x as (select *, {_PRF} from c)
select slice, value, tp, fp, fn, support, not_present, ambiguous, exact, round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1, round(exact / support, 4) AS exact_match from x""")
def a10(spark, d):
    corpus = rendered(spark, d)
    found = process(corpus.select("doc_id", "text")).select("doc_id", "fields.*").unpivot(["doc_id"], ["invoice_number", "date", "amount", "supplier"], "field", "extracted")
    day = lambda f: F.date_format("gold_date", f)
    kind = lambda a, b, c: F.when(F.col("gold_type") == "invoice", a).when(F.col("gold_type") == "receipt", b).otherwise(c)
    number = lambda n: (F.col("doc_id") + n).cast("string")
    gold = corpus.select(
        "doc_id", "gold_type", kind(number(10000), F.concat(F.lit("R"), number(10000)), number(5380000000)).alias("invoice_number"), kind(day("yyyy-MM-dd"), day("dd/MM/yyyy"), day("dd.MM.yyyy")).alias("date"),
        F.when(F.col("doc_id") % 9 == 0, F.lit("none")).otherwise(F.concat(kind(F.lit("$"), F.lit("Rs. "), F.lit("")), F.format_number("gold_total", 2))).alias("amount"), F.col("gold_supplier").alias("supplier"),
    ).unpivot(["doc_id", "gold_type"], ["invoice_number", "date", "amount", "supplier"], "field", "expected")
    status = F.when((F.col("field") == "supplier") & (F.col("doc_id") % 7 == 0), F.lit("AMBIGUOUS")).when((F.col("field") == "date") & (F.col("doc_id") % 11 == 0), F.lit("NOT_PRESENT")).otherwise(F.lit("PRESENT"))
    return P.extraction_scores(gold.join(found, ["doc_id", "field"]).select("expected", "extracted", status.alias("status"), "field", F.col("gold_type").alias("type")), ["field", "type"])


_CMP = "regexp_replace(lower({}), '[[:punct:]]', '', 'g')"


@query("j2_target_scores", f"with p as (select doc_id, case when doc_id % 3 = 0 then null else {_CMP.format('source')} end v, doc_id % 50 k from documents), t as (select doc_id % 50 k, list(distinct {_CMP.format('source')}) ts from documents where doc_id % 4 = 1 and doc_id % 50 < 40 group by 1), r as (select coalesce(v, '') v, coalesce(len(ts), 0) > 0 wanted, coalesce(len(list_filter(ts, lambda x: x <> '' and coalesce(v, '') <> '' and (contains(v, x) or contains(x, v)))) > 0, false) hit from p left join t using (k)), c as (select count(*) filter (where hit) tp, count(*) filter (where v <> '' and not hit) fp, count(*) filter (where wanted and not hit) fn from r), x as (select *, {_PRF} from c) select 'source' AS field, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1 from x")
def j2(spark, d):
    docs = _docs(spark, d)
    said = docs.select("doc_id", F.lit("source").alias("field"), F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("source")).alias("value"))
    sets = docs.where("doc_id % 4 = 1 and doc_id % 50 < 40").groupBy((F.col("doc_id") % 50).alias("k")).agg(F.collect_set("source").alias("targets"))
    return P.target_scores(said, docs.select("doc_id", (F.col("doc_id") % 50).alias("k")).join(sets, "k").select("doc_id", F.lit("source").alias("field"), "targets"))


_LABELS = ["Invoice No", "Date of issue", "TOTAL ($)", "Vendor name", "hello", "Unit price", "Ship from"]


@query("p17_form_fields", "select doc_id, [ 'invoice_number', 'date', 'amount', 'supplier', null, 'amount', 'supplier'][1 + doc_id % 7] AS field from documents")
def p17(spark, d):
    return _docs(spark, d).select("doc_id", P.form_field(F.get(F.array(*map(F.lit, _LABELS)), (F.col("doc_id") % 7).cast("int"))).alias("field"))


# Latencies: events as runs of a user's documents.
_RUNS = "r0 as (select user_id document, case when user_id % 2 = 0 then 'native' else 'ocr' end modality, event_id run, event_type stage, cast(value as double) secs, event_id % 13 <> 0 success from events), r as (select *, run = min(run) over (partition by document) cold from r0)"


def runs(spark, d):
    rows = read(spark, d, "events").select(F.col("user_id").alias("document"), F.when(F.col("user_id") % 2 == 0, F.lit("native")).otherwise(F.lit("ocr")).alias("modality"), F.col("event_id").alias("run"), F.col("event_type").alias("stage"), F.col("value").cast("double").alias("seconds"), (F.col("event_id") % 13 != 0).alias("success"))
    first = rows.groupBy("document").agg(F.min("run").alias("_first"))
    return rows.join(first, "document").withColumn("cold", F.col("run") == F.col("_first")).drop("_first")


@query("a16_cold_and_steady", f"with {_RUNS}, p as (select modality, document, min(secs) filter (where cold) cold, avg(secs) filter (where not cold) steady from r group by all), w as (select modality, avg(steady) whole from p group by modality), x as (select *, coalesce(steady, whole) own from p join w using (modality) where cold is not null) select modality, document, round(cold, 4) AS cold_s, round(own, 4) AS steady_s, round(cold - own, 4) AS overhead_s, case when own > 0 then round(cold / own, 2) else 0.0::double end AS factor, round(cold - whole, 4) AS overhead_of_modality_s from x")
def a16(spark, d):
    return P.cold_and_steady(runs(spark, d))


@query("a17_latency_summary", f"with {_RUNS}, p as (select modality, document, sum(secs) total, max(struct_pack(s := secs, n := stage)) w from r where secs is not null group by all) select modality, count(*) AS documents, round(avg(total), 6) AS mean, round(median(total), 6) AS median, round(min(total), 6) AS min, round(max(total), 6) AS max, max(struct_pack(t := total, n := document)).n AS slowest_document, max(w).n AS slowest_stage, round(max(w).s, 6) AS slowest_stage_s from p group by modality")
def a17(spark, d):
    return P.latency_summary(runs(spark, d), ["modality"])


@query("a18_success_rates", f"with {_RUNS} select modality, count(*) AS n, count(*) filter (where success) AS succeeded, round(count(*) filter (where success) / count(*), 4) AS rate from r group by modality")
def a18(spark, d):
    return P.success_rates(runs(spark, d), ["modality"])


@query("a18_failures", f"with {_RUNS} select document, run, stage from r where not success")
def a18f(spark, d):
    return P.failures(runs(spark, d), ["document", "run", "stage"])


# Datasets: documents as labelled texts of three sources.
_SETS = "e as (select case when doc_id % 10 < 8 then 'train' else 'val' end split, ['invoice', 'purchase_order', 'receipt'][1 + doc_id % 3] label, 'doc-' || cast(doc_id as varchar) name, text from documents)"


def examples(spark, d):
    docs = _docs(spark, d).select((F.col("doc_id") % 3).alias("k"), F.when(F.col("doc_id") % 10 < 8, F.lit("train")).otherwise(F.lit("test")).alias("split"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), "text")
    return N.united({label: docs.where(F.col("k") == k) for k, label in enumerate(("invoice", "purchase_order", "receipt"))}, {"test": "val"})


@query("a19_dataset_counts", f"with {_SETS} select split, label, count(*) AS n from e group by all")
def a19(spark, d):
    return P.dataset_counts(examples(spark, d))


@query("s20_numbered", f"with {_SETS} select name, split, label, case label when 'purchase_order' then 'po' else label end || '_' || printf('%04d', row_number() over (partition by split, label order by substr(md5(name), 1, 2), name)) || '.txt' AS file from e where regexp_replace(coalesce(text, ''), '\\s', '', 'g') <> ''")
def s20(spark, d):
    return N.numbered(examples(spark, d), {"purchase_order": "po"}).select("name", "split", "label", "file")


@query("s21_cache_outcome", "select count(*) AS selected, count(*) filter (where doc_id % 3 <> 0 and trim(coalesce(text, '')) <> '') AS processed, count(*) filter (where doc_id % 3 = 0) AS skipped, count(*) filter (where doc_id % 3 <> 0 and text is null) AS failed, count(*) filter (where doc_id % 3 <> 0 and text is not null and trim(text) = '') AS empty from documents")
def s21(spark, d):
    docs = _docs(spark, d)
    return N.cache_outcome(N.cache_plan(docs.select("doc_id", "text"), docs.where("doc_id % 3 = 0").select("doc_id"), "doc_id"))


@query("s18_manifest_audit", "with f as (select cast(doc_id as varchar) name, sha256(text) h from documents where text is not null), m as (select name, case when cast(name as bigint) % 17 = 0 then 'x' else h end e from f union all select 'gone', 'y') select case when h is null then 'missing file' else 'digest differs' end AS problem, name, e AS expected, h AS found from m left join f using (name) where h is distinct from e union all select 'row count', null, '0', cast(count(*) as varchar) from m")
def s18(spark, d):
    files = _docs(spark, d).where("text is not null").select(F.col("doc_id").cast("string").alias("name"), F.sha2("text", 256).alias("sha256"))
    listed = files.select("name", F.when(F.col("name").cast("long") % 17 == 0, F.lit("x")).otherwise(F.col("sha256")).alias("sha256"))
    gone = files.groupBy().agg(F.lit("gone").alias("name"), F.lit("y").alias("sha256"))
    return N.manifest_audit(listed.union(gone), files, rows=0)


@query("g2_tasks", "with c as (select doc_id, text, unnest(range(0, cast(greatest(length(text) - 101, 0) + 1 as bigint), 900)) s from documents where length(text) > 0), t as (select doc_id, length(substr(text, s + 1, 1000)) n from c) select 'head' AS task, count(*) AS n, cast(0 as bigint) AS errors from t union all select 'question', count(*), count(*) filter (where n < 200) from t")
def g2(spark, d):
    return N.tasks(G.chunks(_docs(spark, d)), ("head", "question"), _task).groupBy("task").agg(F.count("*").alias("n"), F.count("error").alias("errors"))


def _task(kind, content):
    return F.substring(content, 1, 20) if kind == "head" else F.when(F.length(content) >= 200, F.concat(F.lit("What follows? "), F.substring(content, 1, 40)))


@query("g4_job_account", "with c as (select doc_id, length(substr(text, s + 1, 1000)) n from (select doc_id, text, unnest(range(0, cast(greatest(length(text) - 101, 0) + 1 as bigint), 900)) s from documents where length(text) > 0)), o as (select distinct doc_id from c where n >= 200), x as (select count(distinct doc_id) total, count(distinct doc_id) filter (where doc_id in (select doc_id from o)) processed from documents) select total, processed, total - processed AS failed, case when total = processed then 'completed' when processed = 0 then 'failed' else 'partial' end AS status from x")
def g4(spark, d):
    docs = _docs(spark, d)
    return N.job_account(N.tasks(G.chunks(docs), ("question",), _task), docs)


@query("g3_marked", "select coalesce(q = 1, false) AS approved, count(*) AS n from documents left join (select doc_id, max(case when quality = 1 then 1 else 0 end) q from labels group by doc_id) using (doc_id) group by 1")
def g3(spark, d):
    return N.marked_approved(_docs(spark, d).select("doc_id"), read(spark, d, "labels")).groupBy("approved").agg(F.count("*").alias("n"))


def _layout_sql() -> str:
    count = lambda c, words: " + ".join(f"(length({c}) - length(replace({c}, '{w}', ''))) / {len(w)}" for w in words)
    word = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
    found = lambda pattern: f"len(regexp_extract_all(t, '{pattern}'))"
    values = {
        "char_count": "length(t)", "word_count": found(word + "(?:" + word.replace("]", "''-]") + "*" + word + ")?"), "line_count": "n",
        "average_line_length": "case when n > 0 then list_sum(list_transform(ls, lambda s: length(s))) / n else 0 end", "max_line_length": "coalesce(list_max(list_transform(ls, lambda s: length(s))), 0)",
        "digit_ratio": r"length(regexp_replace(solid, '\P{Nd}', '', 'g')) / greatest(length(solid), 1)", "uppercase_ratio": r"length(regexp_replace(solid, '\P{Lu}', '', 'g')) / greatest(length(solid), 1)",
        "currency_symbol_count": count("t", ("$", "Rs", "RM")), "amount_like_count": found("(?i)" + L.AMOUNT), "date_like_count": found("(?i)" + L.DATE),
        **{name: count("a", words) for name, words in L.TOP.items()}, "bottom_region_total_keyword_count": count("z", L.TOTALS), **{name: count("l", words) for name, words in L.WHOLE.items()},
        "line_item_density_proxy": f"({count('l', L.WHOLE['item_table_keyword_count'])}) / greatest(n, 1)", "total_near_bottom_proxy": f"case when {count('z', L.TOTALS)} > 0 then 1 else 0 end",
    }
    return rf"""with x as (select doc_id, coalesce(text, '') t, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0B\f\x1C-\x1E]'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') ls from documents),
y as (select *, len(ls) n, cast(greatest(ceil(len(ls) * 0.25), 1) as bigint) k, regexp_replace(t, '\s+', '', 'g') solid, lower(t) l from x),
z as (select *, lower(array_to_string(ls[1:k], chr(10)) || chr(10) || substr(t, 1, 500)) a, lower(array_to_string(ls[greatest(n - k + 1, 1):n], chr(10)) || chr(10) || right(t, 500)) z from y)
select doc_id, {", ".join(f"round(cast({v} as double), 9) AS {name}" for name, v in values.items())} from z"""


@query("m3_layout_features", _layout_sql())
def m3(spark, d):
    f = L.with_layout(_docs(spark, d).select("doc_id", "text"))
    return f.select("doc_id", *[F.round(c, 9).alias(c) for c in L.NAMES])


# Stored rows.


@query("q13_user_corpus", "select doc_id, cast(row_number() over (order by doc_id % 1000, doc_id) as integer) AS doc_ord from documents where doc_id % 7 = 3 and trim(coalesce(text, '')) <> ''")
def q13(spark, d):
    texts = _docs(spark, d).select("doc_id", "text")
    return D.user_corpus(_stored(spark, d).join(texts, "doc_id"), 3).select("doc_id", "doc_ord")


@query("j7_owned", "select doc_id from documents where doc_id % 7 = 5")
def j7(spark, d):
    return D.owned(_stored(spark, d), 5).select("doc_id")


@query("j9_whole_documents", "select doc_id, lang AS label, case when doc_id % 2 = 0 then source end AS supplier, case when doc_id % 3 = 0 then 'd' || cast(doc_id as varchar) end AS date, case when doc_id % 5 = 0 then 'processed' end AS pipeline_status from documents")
def j9(spark, d):
    docs = _docs(spark, d)
    field = lambda name, k, v: docs.where(f"doc_id % {k} = 0").select("doc_id", F.lit(name).alias("field_name"), v.alias("field_value"))
    extracted = field("supplier", 2, F.col("source")).union(field("date", 3, F.concat(F.lit("d"), F.col("doc_id").cast("string"))))
    whole = D.whole_documents(docs.select("doc_id"), docs.select("doc_id", F.col("lang").alias("label")), extracted, docs.where("doc_id % 5 = 0").select("doc_id", F.lit("processed").alias("pipeline_status")))
    return whole.select("doc_id", "label", "supplier", "date", "pipeline_status")


@query("p20_history_rows", "select 'f' || cast(doc_id as varchar) AS filename, case when doc_id % 4 = 0 then 'Receipt' else 'Purchase Order' end AS type, case when doc_id % 4 = 0 then 'Needs review' else 'Processed' end AS status, case when doc_id % 4 = 0 then source end AS supplier from documents")
def p20(spark, d):
    result = F.when(F.col("doc_id") % 4 == 0, F.to_json(F.struct(F.struct(F.lit("receipt").alias("label")).alias("classification"), F.struct(F.lit("needs_review").alias("pipeline_status")).alias("validation"), F.struct(F.col("source").alias("supplier")).alias("fields")))).otherwise(F.lit("no json"))
    records = _docs(spark, d).select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("filename"), F.lit(None).cast("timestamp").alias("created_at"), F.lit("purchase_order").alias("document_type"), result.alias("result_json"))
    return D.history_rows(records).select("filename", "type", "status", "supplier")


@query("p23_defaults", "select doc_id, coalesce(nullif(case when doc_id % 2 = 0 then lang end, ''), source) AS type, cast(doc_id as varchar) AS id from documents")
def p23(spark, d):
    records = _docs(spark, d).select("doc_id", F.lit("").alias("text"), F.col("text").alias("raw_text"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("").alias("type"), F.col("source").alias("document_type"), F.lit(None).cast("string").alias("id"), F.col("doc_id").alias("document_id"))
    return D.with_defaults(records).select("doc_id", "type", "id")


@query("p25_casts", "select c_custkey, try_cast(case when c_custkey % 3 = 0 then c_name else cast(c_custkey as varchar) end as bigint) AS whole, try_cast(case when c_custkey % 4 = 0 then 'x' else cast(c_acctbal as varchar) end as double) AS number from customer")
def p25(spark, d):
    text = lambda k, other, own: F.when(F.col("c_custkey") % k == 0, other).otherwise(own.cast("string"))
    return read(spark, d, "customer").select("c_custkey", D.as_whole(text(3, F.col("c_name"), F.col("c_custkey"))).alias("whole"), D.as_number(text(4, F.lit("x"), F.col("c_acctbal"))).alias("number"))


# Readers.


@query("s1_kinds", "select doc_id, ['pdf', 'image', 'txt', null, 'docx', 'csv'][1 + doc_id % 6] AS kind from documents")
def s1(spark, d):
    name = F.get(F.array(*map(F.lit, ("a/b.PDF", "x.jpeg", "n.Txt", "no.zip", "w.docx", "t.v.csv"))), (F.col("doc_id") % 6).cast("int"))
    return _docs(spark, d).select("doc_id", R.kind_of(name).alias("kind"))


@query("s5_csv_lines", "select row_number() over (order by c_custkey) AS row, 'Row ' || cast(row_number() over (order by c_custkey) as varchar) || ': c_custkey: ' || cast(c_custkey as varchar) || ' | c_name: ' || c_name AS text from customer")
def s5(spark, d):
    return R.csv_lines(read(spark, d, "customer"), ["c_custkey", "c_name"], "c_custkey").select(F.col("row").cast("long").alias("row"), "text")


@query("s13_box_lines", "select event_id, event_type || ',' || cast(user_id as varchar) || ',b' AS text from events")
def s13(spark, d):
    u = F.col("user_id").cast("string")
    line = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("1,2, 3,4,5,6,7,8, "), "event_type", F.lit(" ,"), u, F.lit(", b ,0.98"))).otherwise(F.concat(F.lit("1,2,3,4.5,"), "event_type", F.lit(","), u, F.lit(",b")))
    return read(spark, d, "events").select("event_id", R.box_text(line).alias("text"))


@query("s15_form_answers", "select l_orderkey AS doc, 'q' || cast(l_linenumber as varchar) AS question, 'a' || cast(l_partkey as varchar) AS answer from lineitem where l_linenumber % 3 <> 0 group by all")
def s15(spark, d):
    n = F.col("l_linenumber")
    asked = F.struct((2 * n).alias("id"), F.lit("question").alias("label"), F.concat(F.lit("q"), n.cast("string")).alias("text"), F.when(n % 2 == 0, F.array(F.array(2 * n, 2 * n + 1))).otherwise(F.array().cast("array<array<int>>")).alias("linking"))
    told = F.struct((2 * n + 1).alias("id"), F.lit("answer").alias("label"), F.when(n % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" a"), F.col("l_partkey").cast("string"))).alias("text"), F.when(n % 2 == 1, F.array(F.array(2 * n + 1, 2 * n))).otherwise(F.array().cast("array<array<int>>")).alias("linking"))
    forms = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.flatten(F.collect_list(F.array(asked, told))).alias("form"))
    return R.form_answers(forms)


# Search.


@query("w4_weak_queries", f"""with {_TOP}, rel as (select query_id, count(*) n from t where same group by query_id), g as (select query_id, count(*) filter (where same) f, min(rank) filter (where same) first, sum(case when same then 1 / log2(rank + 1) else 0 end) dcg from r where rank <= 5 group by query_id), i as (select query_id, n, (select sum(1 / log2(x + 1)) from unnest(range(1, cast(least(n, 5) as bigint) + 1)) u(x)) ideal from rel) select query_id from g join i using (query_id) where first is null or dcg / ideal < 0.85 or f / n < 0.75""")
def w4(spark, d):
    return M.weak_queries(M.graded_metrics(*_graded(spark, d), (5,))).select("query_id")


@query("a12_no_match", "with q as (select c_custkey % 3 = 0 empty from customer where c_custkey % 2 = 0) select count(*) AS n, count(*) filter (where empty) / count(*) AS accuracy from q")
def a12(spark, d):
    c = read(spark, d, "customer")
    asked = c.select(F.col("c_custkey").alias("query_id"), (F.col("c_custkey") % 2 == 0).alias("expects_no_results"))
    return M.no_match_accuracy(asked, c.where("c_custkey % 3 != 0").select(F.col("c_custkey").alias("query_id"), F.col("c_custkey").alias("doc_id")))


@query("q16_corpus_violations", "select 'missing column fields' AS problem, cast(1 as bigint) AS n union all select 'missing column filename', 1 union all select 'missing column type', 1 union all select 'empty text', count(*) from documents where coalesce(text, '') = '' having count(*) > 0")
def q16(spark, d):
    return S.corpus_violations(_docs(spark, d))


@query("q1_known_suppliers", """with s as (select s_suppkey, replace(s_name, '#', ' ') s_name from supplier) select s_suppkey AS query_id, 'invoice' AS document_type, s_name AS supplier, cast(s_suppkey * 10 as decimal(18,4)) AS amount_gt, 'paper' AS semantic_text from s""")
def q1s(spark, d):
    s = read(spark, d, "supplier").withColumn("s_name", F.replace("s_name", F.lit("#"), F.lit(" ")))
    asked = s.select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("invoices from "), F.lower("s_name"), F.lit(" over "), (F.col("s_suppkey") * 10).cast("string"), F.lit(" paper")).alias("query"))
    parsed = parse_queries(asked, s.select(F.col("s_name").alias("supplier")))
    return parsed.select("query_id", "document_type", "supplier", "amount_gt", "semantic_text")


@query("q1_numbers", "select o_orderkey AS query_id, ['purchase_order', 'invoice', 'receipt'][1 + o_orderkey % 3] AS document_type, 'N' || cast(o_orderkey as varchar) AS document_number, 'office' AS semantic_text from orders")
def q1n(spark, d):
    word = F.get(F.array(F.lit("PO number "), F.lit("invoice "), F.lit("receipt ")), (F.col("o_orderkey") % 3).cast("int"))
    asked = read(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.concat(word, F.lit("N"), F.col("o_orderkey").cast("string"), F.lit(" office")).alias("query"))
    return parse_queries(asked).select("query_id", "document_type", "document_number", "semantic_text")


@query("q1_date_clauses", "select o_orderkey AS query_id, case o_orderkey % 4 when 0 then cast(o_orderdate as date) end AS date_gt, case o_orderkey % 4 when 1 then cast(o_orderdate as date) end AS date_lte, case o_orderkey % 4 when 2 then cast(o_orderdate as date) end AS date_eq, o_orderkey % 4 = 3 AS incomplete from orders")
def q1d(spark, d):
    day = lambda f: F.date_format("o_orderdate", f)
    k = F.col("o_orderkey") % 4
    said = F.when(k == 0, F.concat(F.lit("later than "), day("d MMMM yyyy"))).when(k == 1, F.concat(F.lit("on or before "), day("dd/MM/yyyy"))).when(k == 2, F.concat(F.lit("dated "), day("yyyy-MM-dd"))).otherwise(F.concat(F.lit("after "), day("MMMM yyyy")))
    parsed = parse_queries(read(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("orders "), said).alias("query")))
    return parsed.select("query_id", "date_gt", "date_lte", "date_eq", F.col("error").isNotNull().alias("incomplete"))


@query("p19_highlight", r"select doc_id, md5(regexp_replace(text, '\b(friend|river|the)\b', '**\1**', 'gi')) AS marked_md5 from documents")
def p19(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.highlight(F.col("text"), F.lit("the of river friend"))).alias("marked_md5"))

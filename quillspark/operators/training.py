"""Training examples: chunks with context, splits, exports; and the text classifier."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizerModel, HashingTF, NGram, Normalizer, RegexTokenizer, SQLTransformer, StopWordsRemover, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written_for


def chunks(docs: DataFrame, size: int = 1000, overlap: int = 100, doc_id: str = "doc_id", text: str = "text", context: int = 100) -> DataFrame:
    """(doc_id, chunk_index, start, end, content, token_count, preceding, following); empty texts have none.

    A text is split once into parts as long as a chunk's step, and chunks and contexts are put together from neighbouring parts:
    no cut walks the text from its beginning. overlap and context are at most that step.
    """
    step, t = size - overlap, F.col(text)
    if not 0 <= max(overlap, context) <= step:
        raise ValueError("overlap and context must not be longer than a chunk's step")
    parts = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    count = F.when(F.length(t) > 0, F.floor((F.greatest(F.length(t) - overlap - 1, F.lit(0))) / step).cast("int") + 1).otherwise(0)
    part = lambda i: F.coalesce(F.get("_parts", i), F.lit(""))

    def piece(_: Column, i: Column) -> Column:
        start = i * step
        end = F.least(start + size, F.col("_length"))
        return F.struct(
            i.alias("chunk_index"),
            start.alias("start"),
            end.alias("end"),
            F.substring(F.concat(part(i), part(i + 1)), 1, size).alias("content"),
            F.greatest(F.lit(1), F.floor((end - start) / 4)).cast("long").alias("token_count"),
            F.substring(part(i - 1), step - context + 1, context).alias("preceding"),
            F.substring(F.concat(part(i + 1), part(i + 2)), overlap + 1, context).alias("following"),
        )

    cut = docs.select(doc_id, parts.alias("_parts"), F.length(t).alias("_length"), count.alias("_count"))
    return cut.select(doc_id, F.explode(F.transform(F.slice("_parts", F.lit(1), F.col("_count")), piece)).alias("p")).select(doc_id, "p.*")


def split_of(key: Column) -> Column:
    """train, validation or test (.8, .1, .1) by the digits of a hash that every engine has."""
    bucket = F.conv(F.substring(F.md5(key.cast("string")), 1, 4), 16, 10).cast("long") % 10
    return F.when(bucket < 8, F.lit("train")).when(bucket == 8, F.lit("validation")).otherwise(F.lit("test"))


def approved(examples: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Examples whose document has quality 1."""
    return examples.join(labels.where("quality = 1").select(doc_id).distinct(), doc_id, "left_semi")


def chat_rows(examples: DataFrame, prompt: str, answer: str, keep: list[str] | None = None) -> DataFrame:
    """Examples as one JSON conversation a row."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return examples.select(F.to_json(F.struct(F.array(message("user", prompt), message("assistant", answer)).alias("messages"))).alias("value"), *(keep or []))


def vocabulary(terms: DataFrame, most: int, column: str = "terms") -> list[str]:
    """The terms that stand in the most rows of an array column, equal ones in their order: at most so many, so they may be read on the driver.

    A term's number is its place, whatever the partitions.
    """
    counts = terms.select(F.explode(F.array_distinct(column)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return [r.term for r in counts.orderBy(F.col("df").desc(), "term").limit(most).collect()]


def text_classifier(train: DataFrame, label: str = "label", text: str = "text", features: int = 1 << 15, named: bool = False) -> PipelineModel:
    """TF-IDF of one and two words, balanced multinomial logistic regression.

    Features are hashed, or with named=True the terms of the most documents (as many), whose names the model then knows. Texts are
    cut into words once (twice with named=True): the counted features are written, and every later pass reads them.
    """
    sizes = {r[0]: r[1] for r in train.groupBy(label).count().collect()}  # a row for each class
    n = sum(sizes.values())
    if not n:
        raise ValueError("no training rows")
    weights = [F.lit(x) for c, size in sizes.items() if c is not None for x in (c, n / (len(sizes) * size))]
    if not weights:
        raise ValueError("no labels")
    weighed = train.where(F.col(label).isNotNull()).withColumn("_w", F.create_map(*weights)[F.col(label)])
    words = [
        RegexTokenizer(inputCol=text, outputCol="_t", pattern=r"\b\w\w+\b", gaps=False),
        StopWordsRemover(inputCol="_t", outputCol="_s"),
        NGram(n=2, inputCol="_s", outputCol="_g"),
    ]
    if named:
        words.append(SQLTransformer(statement="SELECT *, concat(_s, _g) AS _a FROM __THIS__"))
        terms = Pipeline(stages=words).fit(weighed).transform(weighed)
        counts = [CountVectorizerModel.from_vocabulary(vocabulary(terms, features, "_a"), inputCol="_a", outputCol="_f")]
    else:
        hashed = [HashingTF(inputCol=c, outputCol=f"_f{i}", numFeatures=features) for i, c in enumerate(("_s", "_g"), 1)]
        counts = [*hashed, VectorAssembler(inputCols=["_f1", "_f2"], outputCol="_f")]
    counted = Pipeline(stages=[StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc"), *words, *counts]).fit(weighed)
    stages = [
        IDF(inputCol="_f", outputCol="_i"),
        Normalizer(inputCol="_i", outputCol="_x"),
        LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", family="multinomial", standardization=False, regParam=1.0 / n, maxIter=50),
    ]
    with written_for(counted.transform(weighed).select("_y", "_w", "_f"), "features") as rows:
        trained = Pipeline(stages=stages).fit(rows)
    return PipelineModel([*counted.stages, *trained.stages])


def predicted(model: PipelineModel, docs: DataFrame) -> DataFrame:
    """docs with model_label and model_confidence."""
    from pyspark.ml.functions import vector_to_array

    names = model.stages[0].labels
    p = vector_to_array(F.col("probability"))
    out = model.transform(docs.withColumn("_w", F.lit(1.0)))
    return out.select(*docs.columns, F.element_at(F.array(*map(F.lit, names)), F.col("prediction").cast("int") + 1).alias("model_label"), F.array_max(p).alias("model_confidence"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def top_features(model: PipelineModel, names: list[str] | None = None, n: int = 10) -> DataFrame:
    """(class, rank, feature, weight): the features of the largest coefficients by size, a class each; ties by name.

    names: of the vector's places; without them those of the model's vocabulary. A model's coefficients are few, so they are read
    on the driver.
    """
    from pyspark.sql import SparkSession

    if names is None:
        names = next(s.vocabulary for s in model.stages if isinstance(s, CountVectorizerModel))
    labels, weights = model.stages[0].labels, model.stages[-1].coefficientMatrix.toArray()
    rows = [(labels[i] if len(weights) > 1 else labels[-1], name, float(w)) for i, row in enumerate(weights) for name, w in zip(names, row, strict=True)]
    order = Window.partitionBy("class").orderBy(F.abs("weight").desc(), "feature")
    return SparkSession.active().createDataFrame(rows, "class string, feature string, weight double").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("class", "rank", "feature", "weight")

"""The cluster job: words and a language tree in, word families and parameters out."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from wordkin.operators import evaluation
from wordkin.operators.edit_model import EditModel
from wordkin.operators.estimation import fit_alignment_features, fit_alignments, fit_branch_rate, fit_rates
from wordkin.operators.lexicon import BigramModel, alphabet, bigram_counts, fit_bigrams
from wordkin.operators.messages import EdgeModel, Inference, TreeShape, decode, prepare
from wordkin.operators.pairs import EditScorer, expected_alignments
from wordkin.session import cut, need_at_most, passing_cuts, scratch_dir, small

# Fixed values of the job: initial innovation probability, convergence test, Unicode bound.
INITIAL_INNOVATION = 0.4
CONVERGED = 1e-4
MIN_ITERATIONS = 3
UNICODE = 1_200_000


@dataclass
class JobResult:
    clusters: DataFrame
    history: list[dict] = field(default_factory=list)
    model: EdgeModel | None = None
    reason: str = ""


def initial_model(letters: list[str], **options) -> EdgeModel:
    return EdgeModel(
        EditScorer(EditModel.initial(letters)), BigramModel.flat(len(letters)), {}, INITIAL_INNOVATION, **options
    )


def re_estimate(
    step: Inference, letters: list[str], model: EdgeModel, tree: DataFrame | None = None, alignment: str = "closed"
) -> EdgeModel:
    """M-step of the parts that the model has: nodes without counts keep their initial parameters. Where the costs of a
    step were given by another scorer, its pairs are aligned under the initial costs."""
    start = EditModel.initial(letters)
    aligner = model.scorer.model if isinstance(model.scorer, EditScorer) else start
    weights = cut(step.pair_weights())
    new: dict = {}
    if model.factors != "bigrams":
        aligned = cut(
            expected_alignments(
                weights.filter("kept_weight > 0").select("node_id", "parent", "child", F.col("kept_weight").alias("weight")),
                aligner,
            )
        )
        fit = {"closed": fit_alignments, "features": fit_alignment_features}[alignment]
        new["scorer"] = EditScorer(fit(aligned, letters, start).with_initial(list(step.shape.nodes)))
    if model.factors != "edit":
        new_bigrams = cut(
            bigram_counts(
                weights.filter("new_weight > 0").select("node_id", F.col("child").alias("word"), "new_weight"),
                weight=F.col("new_weight"),
            )
        )
        nodes = [r.node_id for r in need_at_most(new_bigrams.select("node_id").distinct(), UNICODE, "model nodes")]
        new["bigrams"] = fit_bigrams(new_bigrams, nodes, len(letters))
    if model.factors == "mixture":
        counts = step.innovation_counts()
        rates = fit_branch_rate(counts, tree) if tree is not None else fit_rates(counts)
        new["innovation"] = {r.node_id: r.p for r in need_at_most(rates, UNICODE, "innovation rates")}
    return replace(model, **new)


class JobState:
    """What a job has settled, in a folder that outlives it: ``clusters``, ``model`` and ``history`` by iteration.

    The history row of an iteration is written last and commits it; whatever else a stopped job has left of an
    iteration is written again. Folders are laid out as those of ``write_iteration``."""

    HISTORY = "log_likelihood double, change double, precision double, recall double, f1 double, reason string"
    TABLES = ("edit_rows", "edit_defaults", "bigram_rows", "bigram_defaults", "innovation")

    def __init__(self, spark: SparkSession, path: str, setup: str, letters: list[str]):
        self.spark, self.path, self.letters = spark, path, letters
        kept = self._read("setup")
        if kept is None:
            spark.createDataFrame([(setup,)], "setup string").coalesce(1).write.parquet(f"{path}/setup")
        elif kept.first().setup != setup:
            raise ValueError(f"{path} holds the state of another job")

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def _write(self, df: DataFrame, name: str, it: int) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/iter={it}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}/iter={it}")

    def history(self) -> list[dict]:
        rows = self._read("history")
        return [] if rows is None else [{k: r[k] for k in ("iter", *(f.split()[0] for f in self.HISTORY.split(", ")))} for r in rows.orderBy("iter").collect()]

    def commit(self, row: dict) -> None:
        values = tuple(row[f.split()[0]] for f in self.HISTORY.split(", "))
        self._write(self.spark.createDataFrame([values], self.HISTORY).coalesce(1), "history", row["iter"])

    def clusters(self, it: int, df: DataFrame | None = None) -> DataFrame:
        return self._read(f"clusters/iter={it}") if df is None else self._write(df, "clusters", it)

    def save_model(self, it: int, model: EdgeModel, node_kind: str) -> None:
        tables: dict = {}
        if isinstance(model.scorer, EditScorer) and model.scorer.model.rows is not None:
            tables |= {"edit_rows": model.scorer.model.rows, "edit_defaults": model.scorer.model.defaults}
        if model.bigrams.rows is not None:
            tables |= {"bigram_rows": model.bigrams.rows, "bigram_defaults": model.bigrams.defaults}
        if model.innovation:
            tables["innovation"] = self.spark.createDataFrame([(k, float(p)) for k, p in model.innovation.items()], f"node_id {node_kind}, p double")
        for name, df in tables.items():
            self._write(df, name, it)

    def load_model(self, it: int, first: EdgeModel, shape: TreeShape) -> EdgeModel:
        """The model that iteration ``it`` estimated; parts it has not estimated are those of the first model."""
        t = {name: self._read(f"{name}/iter={it}") for name in self.TABLES}
        new: dict = {}
        if t["edit_rows"] is not None:
            start = first.scorer.model if isinstance(first.scorer, EditScorer) else EditModel.initial(self.letters)
            model = EditModel(start.alphabet, start.uniform, t["edit_rows"], t["edit_defaults"])
            new["scorer"] = EditScorer(model.with_initial(list(shape.nodes)))
        if t["bigram_rows"] is not None:
            new["bigrams"] = BigramModel(small(t["bigram_rows"]), small(t["bigram_defaults"]), first.bigrams.uniform)
        if t["innovation"] is not None:
            new["innovation"] = {r.node_id: r.p for r in need_at_most(t["innovation"], UNICODE, "innovation rates")}
        return replace(first, **new)


def run_job(
    words: DataFrame,
    tree: DataFrame,
    max_iterations: int | None = None,
    alignment: str = "closed",
    branch_lengths_after: int | None = None,
    state: str | None = None,
    first: EdgeModel | None = None,
    **options,
) -> JobResult:
    """EM over all slots. Stops when the relative change of the likelihood falls below the
    bound (a falling likelihood included) after the first iterations.

    ``state`` names a folder for what the iterations settle (default: one in the shared scratch folder). A job that is
    started again with the folder of one that was stopped goes on behind its last committed iteration. Tables between
    the steps of an iteration are deleted when it is committed."""
    spark = words.sparkSession
    words = cut(words)
    shape = TreeShape.of(tree)
    letters = [r.ch for r in need_at_most(alphabet(words).orderBy("idx"), UNICODE, "alphabet")]
    prepared = prepare(words, shape)
    first = first or initial_model(letters, **options)
    sums = words.agg(F.count("*").alias("n"), F.sum(F.crc32(F.concat_ws("|", "slot", "language", "word").cast("binary"))).alias("s")).first()
    setup = repr((sums.n, sums.s, "".join(letters), sorted(map(str, shape.nodes)), alignment, branch_lengths_after, sorted(options.items())))
    kept = JobState(spark, state or f"{scratch_dir(spark)}/job-{uuid4().hex}", setup, letters)
    history = kept.history()
    model = kept.load_model(history[-1]["iter"], first, shape) if history else first
    while True:
        it = len(history)
        if history and (history[-1]["reason"] or it == max_iterations):
            reason = history[-1]["reason"] or "iteration limit"
            return JobResult(kept.clusters(it - 1), history, model, reason)
        if max_iterations is not None and it >= max_iterations:
            return JobResult(words, history, model, "iteration limit")
        with passing_cuts(spark):
            step = Inference(words, shape, model, prepared)
            now = step.likelihood().first().log_likelihood
            last = history[-1]["log_likelihood"] if history else -1e10
            change = (now - last) / abs(now)
            scores = evaluation.precision_recall(kept.clusters(it, decode(words, step))).first()
            done = change < CONVERGED and it > MIN_ITERATIONS
            if not done:
                use_lengths = branch_lengths_after is not None and it + 1 > branch_lengths_after
                kept.save_model(it, re_estimate(step, letters, model, tree if use_lengths else None, alignment), step._kind())
            row = {
                "iter": it,
                "log_likelihood": now,
                "change": change,
                "precision": scores.precision,
                "recall": scores.recall,
                "f1": scores.f1,
                "reason": ("likelihood fell" if change < 0 else "converged") if done else None,
            }
            kept.commit(row)
        history.append(row)
        if not done:
            model = kept.load_model(it, first, shape)


def history_table(result: JobResult, spark) -> DataFrame:
    """One row per iteration; ``reason`` says on the last one why the job stopped."""
    last = len(result.history) - 1
    rows = [(*(v for k, v in h.items() if k != "reason"), result.reason if i == last else None) for i, h in enumerate(result.history)]
    return spark.createDataFrame(rows, "iter int, " + JobState.HISTORY)


def fixed_cost_job(words: DataFrame, tree: DataFrame, scorer="levenshtein") -> tuple[Inference, DataFrame]:
    """One E-step with given costs: a scorer and the smoothed bigram model of the leaves."""
    shape = TreeShape.of(tree)
    return Inference(words, shape, given_model(words, shape, scorer)), words


def given_model(words: DataFrame, shape: TreeShape, scorer="levenshtein") -> EdgeModel:
    n = alphabet(words).count()
    leaf = {k: v for k, v in shape.leaf_of.items()}
    at = F.create_map(*[F.lit(x) for kv in leaf.items() for x in kv])
    counts = bigram_counts(words.filter(F.col("language").isin(list(leaf))).withColumn("node_id", at[F.col("language")]))
    bigrams = fit_bigrams(counts.withColumn("cnt", F.col("cnt").cast("double")), list(shape.nodes), n)
    return EdgeModel(scorer, bigrams, {}, INITIAL_INNOVATION)

"""The registered queries of this subpackage, with production parameters, and their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gif, mixing_lm
from .collocations import collocations
from .exact_dedup import exact_groups
from .jaccard_join import similar_classes
from .packing import pack
from .prefix_trie import prefix_trie
from .secret_scan import scan, shown
from .spaced_seeds import contaminated
from .substring_dedup import remove_repeats
from .toxicity import held_out, learn, score
from .training_order import read_shards, write_shards
from .warc import read_archives, write_archives
from .words import shared_folder, stored


#: The vocabulary that op2 and op5 use.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_lm.score(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)


#: Key of the training order.
ORDER_KEY = 20_250_101


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "shards")
    write_shards(table(spark, sf_dir, "documents"), path, tokenizer_path(), ORDER_KEY)
    return read_shards(spark, path, with_ids=False)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents"))


#: A document is taken as toxic from this score on.
TOXIC = 0.3


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= TOXIC).cast("int").alias("predicted"))


def op8_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = gif.decode(stored(gif.store(table(spark, sf_dir, "documents")), "gif"))
    return decoded.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", gif.feature().alias("feature"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("overlaps") > 0).cast("int").alias("contaminated"), F.col("overlaps.item_id").alias("item_ids"), F.coalesce(F.array_max("overlaps.n_equal"), F.lit(0)).alias("most_equal"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind_no"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.array_sort(F.concat("base", "added"))).alias("spans"), "n_live", "n_copied")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("enter", "exit")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("row")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_packing": op2_packing,
    "op3_mixing_lm": op3_mixing_lm,
    "op4_warc": op4_warc,
    "op5_training_order": op5_training_order,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_toxicity": op7_toxicity,
    "op8_gif": op8_gif,
    "op9_decontamination": op9_decontamination,
    "op10_secret_scan": op10_secret_scan,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_collocations": op12_collocations,
    "op13_exact_dedup": op13_exact_dedup,
}

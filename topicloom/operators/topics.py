"""The relational layer over topic models: assignments, words of topics, dictionaries, names.

Topics come as (topic_id, word, weight) and documents as (key, topic_id, score). Ties are broken by the smaller id and
the earlier word everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EMPTY_NAME = "N/A (empty preprocessing)"


def dense_counts(docs: DataFrame, topics: int, topic: str = "topic_id") -> DataFrame:
    """(topic_id, n) for every topic from 0 to ``topics`` - 1, with 0 for those without documents."""
    counts = docs.groupBy(F.col(topic).cast("int").alias("topic_id")).agg(F.count(F.lit(1)).alias("n"))
    ids = docs.sparkSession.range(topics).select(F.col("id").cast("int").alias("topic_id"))
    return ids.join(counts, "topic_id", "left").select("topic_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def shares(docs: DataFrame, topic: str = "topic_id") -> DataFrame:
    """(topic_id, n, pct): documents of each topic and their share in percent, 2 decimals."""
    counts = docs.where(F.col(topic) >= 0).groupBy(F.col(topic).alias("topic_id")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.select("topic_id", "n", F.round(100.0 * F.col("n") / total.scalar(), 2).alias("pct"))


def cumulative_share(counts: DataFrame) -> DataFrame:
    """(topic_id, n, cum_share): the running share of topics from the largest down; one row a topic, so one partition."""
    w = Window.orderBy(F.desc("n"), "topic_id").rowsBetween(Window.unboundedPreceding, 0)
    total = counts.agg(F.sum("n").alias("total"))
    return counts.withColumn("run", F.sum("n").over(w)).select("topic_id", "n", F.round(F.col("run") / total.scalar(), 6).alias("cum_share"))


def argmax(vector: Column) -> Column:
    """The first position, from 0, of an array's maximum."""
    return (F.array_position(vector, F.array_max(vector)) - 1).cast("int")


def assignments(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, topic_id, score) of the most probable topic; null or empty vectors give topic -1 and no score."""
    empty = F.col(vector).isNull() | (F.size(vector) < 1)
    return df.select(key, F.when(empty, -1).otherwise(argmax(F.col(vector))).cast("int").alias("topic_id"), F.when(~empty, F.array_max(vector)).alias("score"))


def normalized(words: DataFrame) -> DataFrame:
    """The weights of each topic divided by their sum."""
    total = words.groupBy("topic_id").agg(F.sum("weight").alias("total"))
    return words.join(total, "topic_id").select("topic_id", "word", (F.col("weight") / F.col("total")).alias("weight"))


def top_words(words: DataFrame, n: int = 50) -> DataFrame:
    """(topic_id, rank, word, weight): the n heaviest words of each topic."""
    w = Window.partitionBy("topic_id").orderBy(F.desc("weight"), "word")
    return words.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("topic_id", "rank", "word", "weight")


def best_topic_of_word(words: DataFrame, least: float = 0.0035, most: int = 500) -> DataFrame:
    """(word, topic_id, prob): the topic in which each word is most probable, words from ``least`` on, the ``most`` most probable."""
    best = words.groupBy("word").agg(F.max(F.struct(F.col("weight").alias("prob"), (-F.col("topic_id")).alias("t"))).alias("m"))
    rows = best.select("word", (-F.col("m.t")).cast("int").alias("topic_id"), F.col("m.prob").alias("prob")).where(F.col("prob") >= least)
    return rows.orderBy(F.desc("prob"), "word").limit(most)


def representatives(docs: DataFrame, key: str, n: int = 2, topic: str = "topic_id", score: str = "score") -> DataFrame:
    """(topic_id, rank, key, score): the n documents with the highest score in each topic.

    ``n`` best of each topic by partial aggregation would need an aggregate of bounded lists; Spark's rank filter is
    pushed below the shuffle for ``row_number`` with a limit, which does the same.
    """
    w = Window.partitionBy(topic).orderBy(F.desc(score), key)
    rows = docs.where((F.col(topic) >= 0) & F.col(score).isNotNull()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return rows.select(F.col(topic).alias("topic_id"), "rank", key, F.col(score).alias("score"))


def with_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Add ``name`` from (topic_id, name), by default "Topic <id + 1>"."""
    default = F.concat(F.lit("Topic "), (F.col("topic_id") + 1).cast("string"))
    return rows.join(names.select("topic_id", "name"), "topic_id", "left").withColumn("name", F.coalesce("name", default))


def topic_table(words: DataFrame, n: int = 20) -> DataFrame:
    """(topic_id, words): the first n words of each topic, comma-joined."""
    rows = top_words(words, n).groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("l"))
    return rows.select("topic_id", F.array_join("l.word", ", ").alias("words"))


def words_long(topics: DataFrame) -> DataFrame:
    """(Topic_ID, Rank, Word, Weight) from (topic_id, words array, weights array)."""
    return topics.select(F.col("topic_id").alias("Topic_ID"), F.posexplode(F.arrays_zip("words", "weights")).alias("i", "w")).select("Topic_ID", (F.col("i") + 1).alias("Rank"), F.col("w.words").alias("Word"), F.col("w.weights").alias("Weight"))


def centroids(points: DataFrame, topic: str, x: str, y: str) -> DataFrame:
    """(topic_id, x, y, n): the mean of each topic's points."""
    return points.groupBy(F.col(topic).alias("topic_id")).agg(F.round(F.avg(x), 6).alias("x"), F.round(F.avg(y), 6).alias("y"), F.count(F.lit(1)).alias("n"))


def word_similarity(words: DataFrame, least: float = 0.0) -> DataFrame:
    """(a, b, distance): cosine distance of words as vectors over topics, for words that share a topic; all others have
    distance 1. The dot products come from an equi-join on the topic of a vocabulary of ``best_topic_of_word``'s size."""
    norm = words.groupBy("word").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    a = words.select("topic_id", F.col("word").alias("a"), F.col("weight").alias("wa"))
    b = words.select("topic_id", F.col("word").alias("b"), F.col("weight").alias("wb"))
    dots = a.join(b, "topic_id").where("a < b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    rows = dots.join(norm.select(F.col("word").alias("a"), F.col("norm").alias("na")), "a").join(norm.select(F.col("word").alias("b"), F.col("norm").alias("nb")), "b")
    distance = F.greatest(F.lit(0.0), F.round(1 - F.col("dot") / (F.col("na") * F.col("nb")), 6))
    return rows.select("a", "b", distance.alias("distance")).where(F.col("distance") >= least)


def jaccard(words: DataFrame, n: int = 80) -> DataFrame:
    """(a, b, jaccard) of the sets of top words of each pair of topics that have words in common."""
    sets = top_words(words, n).groupBy("topic_id").agg(F.collect_set("word").alias("s"))
    links = top_words(words, n).select("topic_id", "word")
    pairs = links.select(F.col("topic_id").alias("a"), "word").join(links.select(F.col("topic_id").alias("b"), "word"), "word").where("a < b").select("a", "b").distinct()
    rows = pairs.join(sets.select(F.col("topic_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("topic_id").alias("b"), F.col("s").alias("sb")), "b")
    value = F.size(F.array_intersect("sa", "sb")) / F.greatest(F.lit(1), F.size(F.array_union("sa", "sb")))
    return rows.select("a", "b", F.round(value, 6).alias("jaccard"))


# Name suffixes and the words of which one must occur, with a second list of which one must occur too; the first that holds wins.
RULES = [
    ("Robot_vs_Human_Service_Jobs_Future", "robot robotic humanoid".split(), "human future machine job".split()),
    ("B2B_HospitalityTech_SalesPitch_Solution", "technology hospitality industry solution communication system market".split(), []),
    ("HotelSchool_Lecture_CRM_Ops_Training", "customer operation question datum model system instructor hotel".split(), []),
    ("BookLaunch_Panel_AI_Future_of_Work", "book launch future industry business talent course development".split(), []),
    ("Tokyo_Japan_Travel_Vlog", ["tokyo", "japan", "japanese", "station", "toilet", "tokyo tower", "yen"], []),
    ("HennNa_Chain_Structured_Hotel_Review", "stay modern traveler perfect convenience comfort trip seamless luxury".split(), []),
    ("Hotel_Room_Amenities_Breakfast_Review", "breakfast amenity facility option review great free convenient".split(), []),
    ("Kagoshima_RobotFrontDesk_Dialogue_ServiceRants", "friend coffee order kagoshima name welcome ready bed correct".split(), []),
    ("Orlando_Universal_Staycation_Lifestyle_Vlog", "universal orlando aventura food staycation cool stuff amazing little".split(), []),
    ("NewsPanel_CigaretteTax_LasVegasAI_Hotel", ["news", "cigarette", "tax", "las vegas", "panel", "project", "criminologist", "door", "big"], []),
    ("Podcast_Revenate_SEO_for_LLM_DirectBooking", ["podcast", "revenate", "seo", "llm", "direct booking", "cmo", "website", "drive", "traffic"], []),
]
# Function words that tell a language among a topic's words.
CLUES = {
    "Tagalog (Filipino)": "ayan ang tak yung dito ano kami tayo ito mga lang po sa ko ng na".split(),
    "Spanish": "que los las nos del por con para como una mas pero muy esto esta este estos ser estar".split(),
    "Italian": "che non una musica con qui pero era hai due del il lo anche sono cosa".split(),
    "Afrikaans": "die nie dit daar het yan vir kan van baie dis hulle ons jy ek is was sal".split(),
    "Malay/Indonesian": "yang dan kita kamu dia ini itu ya saya untuk dengan pada dari juga lebih sudah".split(),
}
DEFAULT_SUFFIX = "Mixed_Travel_Commentary"


def named(topics: DataFrame, rules: list[tuple] | None = None, clues: dict[str, list[str]] | None = None) -> DataFrame:
    """(topic_id, short_name, description) from (topic_id, words array): the language with the most function words, from 3 on, the
    first on ties, else English; and the first rule that holds. Only the first 15 words count.

    The description lists ten words, the languages found with their counts, and the suffix.
    """
    clues, rules = CLUES if clues is None else clues, RULES if rules is None else rules
    words = F.transform(F.slice("words", 1, 15), lambda w: F.lower(w))

    def hit(of: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*of)))

    hits = F.array(*(F.struct(hit(of).alias("h"), (-F.lit(i)).alias("i"), F.lit(name).alias("name")) for i, (name, of) in enumerate(clues.items())))
    found = F.filter(hits, lambda x: x["h"] >= 3)
    top = F.regexp_replace(F.array_max(found)["name"], " ", "")
    language = F.when(F.size(found) > 0, F.concat(F.lit("MULTI_"), F.regexp_replace(top, r"[^\p{L}\p{N}]", "_"))).otherwise("EN")
    suffix: Column = F.lit(DEFAULT_SUFFIX)
    for name, one, two in reversed(rules):
        holds = F.arrays_overlap(words, F.array(*map(F.lit, one)))
        if two:
            holds = holds & F.arrays_overlap(words, F.array(*map(F.lit, two)))
        suffix = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(suffix)
    short = F.concat(F.lit("T"), F.lpad(F.col("topic_id").cast("string"), 2, "0"), F.lit("_"), language, F.lit("_"), suffix)
    listed = F.array_join(F.transform(found, lambda x: F.concat(F.lit("('"), x["name"], F.lit("', "), x["h"].cast("string"), F.lit(")"))), ", ")
    signal = F.when(F.size(found) > 0, F.concat(F.lit(" Detected multilingual function-word signal: ["), listed, F.lit("]."))).otherwise("")
    description = F.concat(F.lit("Top-10 words: "), F.array_join(F.slice(words, 1, 10), ", "), F.lit("."), signal, F.lit(" Auto-suffix label="), suffix, F.lit(". Review top-words + representative docs below to refine name."))
    return topics.select("topic_id", short.alias("short_name"), description.alias("description"))


def dictionary(docs: DataFrame, words: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """The topic dictionary: one row a topic with counts, shares, its two best documents and its 15 best words."""
    from topicloom.functions.text import snippet

    best = representatives(docs, key).join(docs.select(key, snippet(text).alias("snippet")), key)
    repr_ = best.groupBy("topic_id").pivot("rank", [1, 2]).agg(F.first("score").alias("theta"), F.first("snippet").alias("snippet"))
    repr_ = repr_.select("topic_id", F.col("1_theta").alias("repr_doc_1_theta"), F.col("1_snippet").alias("repr_doc_1_snippet"), F.col("2_theta").alias("repr_doc_2_theta"), F.col("2_snippet").alias("repr_doc_2_snippet"))
    top = top_words(words, 15).groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("rank", "word", "weight"))).alias("l"))
    top = top.select("topic_id", F.array_join("l.word", ", ").alias("top_15_words"), F.array_join(F.transform("l.weight", lambda x: F.format_number(x, 5)), ", ").alias("top_15_word_probs"))
    rows = top.join(shares(docs), "topic_id", "left").join(names, "topic_id", "left").join(repr_, "topic_id", "left")
    return rows.select("topic_id", F.col("short_name").alias("topic_short_name"), F.col("description").alias("topic_description"), F.coalesce("n", F.lit(0)).alias("num_docs_assigned"), F.coalesce("pct", F.lit(0.0)).alias("pct_training_docs"), "repr_doc_1_theta", "repr_doc_1_snippet", "repr_doc_2_theta", "repr_doc_2_snippet", "top_15_words", "top_15_word_probs")


def attached(df: DataFrame, key: str, assigned: DataFrame, names: DataFrame, tops: DataFrame) -> DataFrame:
    """Input rows with their topic: id, name, score and first three words; rows without text get -1 and a name that says so."""
    three = tops.where("rank <= 3").groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("l")).select("topic_id", F.array_join("l.word", ", ").alias("top3_words"))
    rows = df.join(assigned.select(F.col(key), F.col("topic_id"), F.col("score")), key, "left").withColumn("topic_id", F.coalesce("topic_id", F.lit(-1)))
    rows = rows.join(names.select("topic_id", F.col("short_name").alias("topic_name")), "topic_id", "left").join(three, "topic_id", "left")
    return rows.withColumn("topic_name", F.when(F.col("topic_id") < 0, EMPTY_NAME).otherwise(F.col("topic_name")))

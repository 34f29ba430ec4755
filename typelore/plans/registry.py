"""One query per operator, each over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typelore.functions import patterns as P
from typelore.functions import text as X
from typelore.operators import cleaning as G
from typelore.operators import declarations as C
from typelore.operators import groups as S
from typelore.operators import ingest as B
from typelore.operators import merge as M
from typelore.operators import people as E
from typelore.operators import vectors as V
from typelore.operators import vocabulary as W
from typelore.operators import weights as H
from typelore.plans import collection, given, group_text, type_resolution
from typelore.session import cut_lineage, scratch_path
from typelore.sources import crawl_plan as plan_source
from typelore.sources import sinks, tables
from typelore.sources import threads as threads_source
from typelore.streaming import merge as stream

Query = Callable[[SparkSession, str], DataFrame]

MIN_INNER = 0.25
#: Partners per vector in the top-k form of the inner products.
TOP_INNER = 10
MATRIX_TERMS = ("thor", "tion", "thth", "sich")
CORRELATED_TERMS = ("ther", "thon", "tion", "thre")


def _r6(column: str | Column) -> Column:
    return F.round(column, 6)


def _text_time(df: DataFrame, column: str = "created_datetime") -> DataFrame:
    return df.withColumn(column, F.date_format(column, "yyyy-MM-dd HH:mm:ss"))


# ---- inputs -----------------------------------------------------------------------------------------------------------


def _comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    authored = B.with_created_datetime(B.drop_authorless(given.items(spark, sf_dir)))
    return authored.select(*M.COMMENT_COLUMNS)


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merge_users(None, given.user_updates(spark, sf_dir))


def _written_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged users for joins with comments: written, so that such a join can be split where one user wrote very many."""
    return cut_lineage(_users(spark, sf_dir), "users")


def _written_typed_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(_typed_users(spark, sf_dir), "typed-users")


def _typed_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return type_resolution.users_with_type(_comments(spark, sf_dir), _users(spark, sf_dir))


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_extracted_type(_comments(spark, sf_dir))


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.extract_all(_comments(spark, sf_dir))


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.split_posts(given.people(spark, sf_dir))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.person_features(given.people(spark, sf_dir))


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.posts_table(given.people(spark, sf_dir))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as they stand in the texts."""
    return G.token_table(given.people(spark, sf_dir))


def _counted(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """Counted words in place of the token rows: written, so that the texts are cleaned once for lemmas and counts."""
    return cut_lineage(W.count_words(_tokens(spark, sf_dir), *keys), "counted")


def _lexicon(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nouns as far as the texts know them: every word, and those of three letters and more, which stand in the lexicon."""
    words = cut_lineage(W.vocabulary(tokens), "vocabulary")
    return words, words.filter(F.length("token") > 2).withColumnRenamed("token", "word")


def _lemmas(tokens: DataFrame) -> DataFrame:
    """Lemmas of all words. Written."""
    return cut_lineage(G.noun_lemmas(*_lexicon(tokens)), "lemmas")


def _changes(tokens: DataFrame) -> DataFrame:
    """The lemmas that differ from their form, of tokens or of counted words. Written, so that Spark knows how few they
    are when it plans the joins."""
    words, lexicon = _lexicon(tokens)
    return cut_lineage(G.changing(G.noun_lemmas(G.with_noun_ending(words), lexicon)), "changes")


def _lemma_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _tokens(spark, sf_dir)
    return G.lemmatize(tokens, _changes(tokens))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _counted(spark, sf_dir)
    return W.word_occurrences(counted, _changes(counted))


def _term_counts(spark: SparkSession, sf_dir: str, grains: tuple[str, ...] = ("type", "letter")) -> DataFrame:
    counted = _counted(spark, sf_dir, "person_id" if grains == ("person",) else "type")
    return W.term_counts(counted, grains, _changes(counted))


def _groups(spark: SparkSession, sf_dir: str, grains: tuple[str, ...] = ("type", "letter")) -> DataFrame:
    return S.group_names(given.people(spark, sf_dir), grains)


def _tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term counts for steps that read them more than once: written, so that the texts are cleaned once."""
    return cut_lineage(H.tf(_term_counts(spark, sf_dir)), "tf")


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_text.weighted_terms(_tf(spark, sf_dir), _groups(spark, sf_dir))


def _written_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(_weights(spark, sf_dir), "weights")


# ---- sources and sinks ------------------------------------------------------------------------------------------------


def read_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "comments")
    sinks.write_table(_comments(spark, sf_dir), path)
    return _text_time(tables.read_comments(spark, path))


def read_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "users")
    sinks.write_table(_users(spark, sf_dir), path)
    return tables.read_users(spark, path)


def user_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.user_names(_users(spark, sf_dir))


def read_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "people")
    writer = given.people(spark, sf_dir).write.option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return tables.read_people(spark, path, id_column="person_id", multi_line=False)


def _read_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "threads")
    given.thread_lines(spark, sf_dir).write.text(path)
    return threads_source.read_threads(spark, path)


def read_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    submission = ["id", "subreddit", "hot_rank", "is_self", "num_comments", "link_flair_text", "author_id", "title",
                  "selftext", "created_utc", "score"]
    return _read_threads(spark, sf_dir).select(*submission)


def flatten_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = threads_source.flatten_nested(_read_threads(spark, sf_dir))
    return flat.select(*(c for c in flat.columns if c != "seq"), "seq.rank", F.col("seq.at").alias("place"))


def collect_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.collect_hot(_read_threads(spark, sf_dir))[0]


def collect_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_time(collection.collect_hot(_read_threads(spark, sf_dir))[1])


def collect_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' own listings, some of whose items have been delivered before, on top of the deliveries."""
    listed = given.history(spark, sf_dir).withColumns(
        {
            "content": F.col("title"), "created_utc": F.col("hot_rank"), "upvotes": F.col("hot_rank"), "subreddit": F.lit("own"),
            "submission_flair_text": F.lit(None).cast("string"), "seq": F.lit(2_000_000_000_000) + F.col("hot_rank"),
        }
    )
    current = M.merge_comments(None, given.comment_updates(spark, sf_dir), keep_state=True)
    renamed = B.user_history(listed, 3).withColumn("id", F.concat(F.lit("c"), F.substring("id", 2, 99), F.lit("_0")))
    merged = M.merge_comments(current, B.with_created_datetime(renamed))
    return merged.select("id", "user_id", "parent_submission_id", "parent_comment_id", "title")


def write_user_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "user-types")
    sinks.write_user_types(_typed_users(spark, sf_dir), path)
    return spark.read.parquet(path)


def write_group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "group-stats")
    sinks.write_group_stats(S.summary(_features(spark, sf_dir)), path)
    schema = "group string, individuals long, posts long, " + ", ".join(f"{m} double" for m in S.MEANS)
    stats = spark.read.schema(schema).option("header", True).csv(path)
    return stats.select("group", "individuals", "posts", *(_r6(m).alias(m) for m in S.MEANS))


def write_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "word-counts")
    sinks.write_word_counts(_counts(spark, sf_dir), path)
    return spark.read.schema("token string, occurrences long").json(path)


def _stats_and_tokens(grain: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        features, counted = _features(spark, sf_dir), _counted(spark, sf_dir, "person_id" if grain == "person" else "type")
        lemmas = _changes(counted)
        if grain == "person":
            joined = W.person_stats_and_tokens(features, counted, lemmas)
        else:
            stats = S.group_stats(features) if grain == "type" else S.dichotomy_stats(features)
            joined = W.stats_and_tokens(cut_lineage(stats, "stats"), W.term_counts(counted, (grain,), lemmas))
        path = scratch_path(spark, f"stats-and-tokens-{grain}")
        sinks.write_stats_and_tokens(joined, path)
        return spark.read.parquet(path).withColumns({m: _r6(m) for m in S.MEANS})

    return query


# ---- ingest and merge -------------------------------------------------------------------------------------------------


def crawl_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = given.submissions(spark, sf_dir).groupBy("subreddit").agg(F.count("*").alias("landed"))
    plan = plan_source.crawl_plan(spark).withColumn("flairs", F.array_join("flairs", ";"))
    return plan.join(landed, "subreddit", "left").select(
        "subreddit", "n_hot", "flairs", F.coalesce("landed", F.lit(0)).alias("landed")
    )


def hot_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.hot_top_n(given.submissions(spark, sf_dir)).select("id", "subreddit", "hot_rank")


def select_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = B.hot_top_n(given.submissions(spark, sf_dir))
    return B.select_submissions(hot).select("id", "subreddit", "link_flair_text", "num_comments")


def drop_authorless(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.drop_authorless(given.items(spark, sf_dir)).select("id", "user_id", "parent_comment_id")


def authorless(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.authorless(given.items(spark, sf_dir)).select("id", "parent_comment_id")


def flatten_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = B.flatten_threads(given.items(spark, sf_dir))
    return flat.select("id", "user_id", "parent_submission_id", "parent_comment_id", "title", "content")


def user_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.user_history(given.history(spark, sf_dir), 3)


def merge_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _users(spark, sf_dir)


def merge_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_time(M.merge_comments(None, given.comment_updates(spark, sf_dir)))


def merge_comments_keep_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = M.merge_comments(None, given.comment_updates(spark, sf_dir), keep_parent=True)
    return merged.select("id", "parent_comment_id", "user_id", "upvotes")


def normalise_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.normalise_nulls(given.items(spark, sf_dir)).select("id", "submission_flair_text")


def format_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given.items(spark, sf_dir).select("id", B.format_created(F.col("created_utc")).alias("created_datetime"))


def check_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the raw deliveries, so that copies, missing users and lost parents are found."""
    return B.check_integrity(given.comment_updates(spark, sf_dir), _users(spark, sf_dir))


def _conversation_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a pattern, as a stream takes a plain path for a folder
    path = f"{sf_dir.rstrip('/')}/conversations.parque[t]"
    return spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(path)


def stream_merge_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_items = given.items_of(spark, _conversation_stream(spark, sf_dir))
    updates = B.with_created_datetime(given.deliveries_of(spark, all_items))
    target, state = scratch_path(spark, "stream-comments"), scratch_path(spark, "stream-state")
    stream.stream_merge_comments(updates, target, state).awaitTermination()
    return _text_time(stream.read_merged_comments(spark, target))


def stream_merge_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    authored = B.drop_authorless(given.items_of(spark, _conversation_stream(spark, sf_dir)))
    updates = authored.select(
        F.col("user_id").alias("id"), F.col("user_name").alias("name"), F.col("user_flair_text").alias("flair_text"), "seq"
    )
    target, state = scratch_path(spark, "stream-users"), scratch_path(spark, "stream-state")
    stream.stream_merge_users(updates, target, state).awaitTermination()
    return stream.read_merged_users(spark, target)


# ---- types ------------------------------------------------------------------------------------------------------------


def unbold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given.user_updates(spark, sf_dir).select("id", "seq", X.unbold(F.col("flair_text")).alias("flair_text"))


def type_from_flair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.type_from_flair(given.user_updates(spark, sf_dir)).select("id", "seq", "mbti_type")


def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.lookup(_comments(spark, sf_dir), "u7", column="user_id").select("id", "user_id", "title", "content")


def count_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return type_resolution.type_counts(_comments(spark, sf_dir), _users(spark, sf_dir))


def _declaration(name: str) -> Query:
    return lambda spark, sf_dir: C.extract_declarations(_comments(spark, sf_dir), name)


def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.match_counts(_matches(spark, sf_dir))


def rows_with_k_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.rows_with_k_matches(_matches(spark, sf_dir))


def last_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.last_match(_matches(spark, sf_dir))


def comments_with_user_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = C.type_from_flair(_written_users(spark, sf_dir))
    return C.comments_with_user_type(_extracted(spark, sf_dir), typed).select(
        "id_x", "user_id", "extracted_mbti", "id_y", "mbti_type"
    )


def types_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.types_per_user(_extracted(spark, sf_dir)).withColumn("types", F.array_join("types", ","))


def ambiguous_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ambiguous_users(_extracted(spark, sf_dir)).withColumn("types", F.array_join("types", ","))


def unambiguous_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.unambiguous_type(_extracted(spark, sf_dir))


def _attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = C.type_from_flair(_users(spark, sf_dir))
    return C.attach_comment_type(users, C.unambiguous_type(_extracted(spark, sf_dir)))


def rename_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.rename_sources(_attached(spark, sf_dir))


def project_user_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.project_user_types(_typed_users(spark, sf_dir))


def project_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.project_comments(_comments(spark, sf_dir))


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.preview(_comments(spark, sf_dir), "id").select("id", "user_id", "content")


# ---- vectors ----------------------------------------------------------------------------------------------------------


def _cleaned_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _comments(spark, sf_dir).withColumn("content", X.clean_text(F.col("content")))


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.embed(_cleaned_comments(spark, sf_dir))


def embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per component that is not zero."""
    long = _embedded(spark, sf_dir).select("id", F.posexplode("embedding").alias("slot", "value"))
    return long.filter(F.col("value") != 0).withColumn("value", F.round(F.col("value").cast("double"), 4))


def pairwise_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = V.pairwise_inner(given.table(spark, sf_dir, "embeddings"), min_value=MIN_INNER)
    return pairs.withColumn("value", F.round("value", 5))


def pairwise_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The TOP_INNER vectors of largest inner product for every vector, over the whole table."""
    ranked = V.top_inner(given.table(spark, sf_dir, "embeddings"), TOP_INNER)
    return ranked.withColumn("value", F.round("value", 5))


def label_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = V.label_vectors(
        _embedded(spark, sf_dir), _comments(spark, sf_dir), _written_typed_users(spark, sf_dir)
    )
    return labelled.select("id", "label", F.size("embedding").alias("dim"))


def project_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = V.project_2d(given.table(spark, sf_dir, "embeddings"), "vec_id")
    return points.select("vec_id", _r6("x_1").alias("x_1"), _r6("x_2").alias("x_2"))


def plot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = cut_lineage(_embedded(spark, sf_dir), "vectors")
    table = V.plot_table(V.project_2d(vectors), _comments(spark, sf_dir), _written_typed_users(spark, sf_dir))
    return table.select(_r6("x_1").alias("x_1"), _r6("x_2").alias("x_2"), "content", "label")


def tidy_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _comments(spark, sf_dir).select("id", X.tidy_comment(F.col("content")).alias("content"))


# ---- people and groups ------------------------------------------------------------------------------------------------


def split_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per post, numbered from 0."""
    return _split(spark, sf_dir).select("person_id", F.posexplode("posts").alias("post_no", "post"))


def posts_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.posts_count(_split(spark, sf_dir)).select("person_id", "posts_count")


def posts_without_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.posts_without_urls(_split(spark, sf_dir)).select(
        "person_id", F.posexplode("posts_without_urls").alias("post_no", "post")
    )


def urls_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.urls_count(_split(spark, sf_dir)).select("person_id", "urls_count")


def punctuations_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = E.posts_without_urls(_split(spark, sf_dir))
    return E.punctuations_count(people).select("person_id", "punctuations_count")


def emojis_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.emojis_count(E.posts_without_urls(_split(spark, sf_dir))).select("person_id", "emojis_count")


def emojis_count_documented(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = E.posts_without_urls(_split(spark, sf_dir))
    return E.emojis_count(people, "documented").select("person_id", "emojis_count")


def count_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = E.posts_without_urls(E.posts_count(_split(spark, sf_dir)))
    means = E.count_means(E.emojis_count(E.punctuations_count(E.urls_count(people))))
    return means.select("person_id", *(_r6(m).alias(m) for m in S.MEANS))


def dichotomies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.dichotomies(given.people(spark, sf_dir)).select("person_id", "type", "is_E", "is_S", "is_T", "is_J")


def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.type_counts(given.people(spark, sf_dir))


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.profile(given.items(spark, sf_dir))


def person_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).withColumns({m: _r6(m) for m in S.MEANS})


def _rounded(stats: DataFrame) -> DataFrame:
    return stats.withColumns({m: _r6(m) for m in S.MEANS})


def group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.group_stats(_features(spark, sf_dir)))


def dichotomy_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.dichotomy_stats(_features(spark, sf_dir)))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(group_text.group_summary(given.people(spark, sf_dir)))


def rank_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = S.rank_groups(S.summary(_features(spark, sf_dir)), "mean_punctuation_count")
    return ranked.withColumn("mean_punctuation_count", _r6("mean_punctuation_count"))


def group_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.group_content(given.people(spark, sf_dir))


# ---- cleaning and vocabulary ----------------------------------------------------------------------------------------

_STEPS = {
    "remove_urls": X.remove_urls,
    "remove_emojis": X.remove_emojis,
    "remove_punctuation": X.remove_punctuation,
    "lower": F.lower,
    "special_to_blank": X.special_to_blank,
    "remove_digits": X.remove_digits,
    "collapse_blanks": X.collapse_blanks,
    "trim": F.trim,
}


def _step(last: str) -> Query:
    """Posts after all steps up to ``last``, in their fixed order."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = F.col("post")
        for name, step in _STEPS.items():
            text = step(text)
            if name == last:
                break
        return _posts(spark, sf_dir).select("person_id", "post_no", text.alias("text"))

    return query


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.clean_posts(_posts(spark, sf_dir)).select("person_id", "post_no", "cleaned")


def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.tokenize_posts(_posts(spark, sf_dir)).drop("type")


def remove_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.remove_stopwords(G.tokenize_posts(_posts(spark, sf_dir))).drop("type")


def noun_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lemmas(_tokens(spark, sf_dir))


def lemmatize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lemma_tokens(spark, sf_dir).drop("type")


def clean_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = G.clean_preview(given.people(spark, sf_dir), "INFP", lemmas=_lemmas(_tokens(spark, sf_dir)))
    return shown.withColumn("tokens", F.array_join("tokens", " "))


def clean_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.group_tokens(_lemma_tokens(spark, sf_dir))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.vocabulary(_counts(spark, sf_dir))


def word_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


def occurrence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.occurrence_histogram(cut_lineage(_counts(spark, sf_dir), "counts"))


def rare_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.rare_words(_counts(spark, sf_dir))


def rarity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.rarity_summary(_counts(spark, sf_dir))


def remove_rare_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _tokens(spark, sf_dir)
    lemmas = _changes(tokens)
    rare = cut_lineage(W.rare_words(W.word_occurrences(tokens, lemmas)), "rare-words")
    return W.remove_rare_words(cut_lineage(G.lemmatize(tokens, lemmas).drop("type"), "lemma-tokens"), rare)


# ---- weights ----------------------------------------------------------------------------------------------------------


def tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.tf(_term_counts(spark, sf_dir)).select("group", "term", "tf")


def df_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.df_idf(_tf(spark, sf_dir), _groups(spark, sf_dir)).withColumn("idf", _r6("idf"))


def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir).withColumn("tfidf", _r6("tfidf"))


def tfidf_per_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every person a group of their own: a frequent term then has very many rows."""
    counts = cut_lineage(H.tf(_term_counts(spark, sf_dir, ("person",))), "tf-person")
    salts = min(256, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return group_text.weighted_terms(counts, _groups(spark, sf_dir, ("person",)), salts).withColumn("tfidf", _r6("tfidf"))


def tfidf_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = H.tfidf_matrix(_weights(spark, sf_dir), MATRIX_TERMS)
    return wide.select("group", *(_r6(f"`{t}`").alias(t) for t in MATRIX_TERMS))


def term_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = H.term_correlation(_written_weights(spark, sf_dir), CORRELATED_TERMS, _groups(spark, sf_dir))
    return pairs.withColumn("correlation", F.round("correlation", 5))


def group_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.group_indicators(_weights(spark, sf_dir))


def term_group_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = H.term_group_correlation(_written_weights(spark, sf_dir), _groups(spark, sf_dir))
    return grid.withColumn("correlation", F.round("correlation", 5))


def term_group_correlation_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    sparse = H.term_group_correlation_sparse(_written_weights(spark, sf_dir), _groups(spark, sf_dir))
    return sparse.withColumns({c: F.round(c, 5) for c in ("correlation", "correlation_elsewhere")})


def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients are rounded before they are ranked, so that ties fall to the term's name."""
    grid = H.term_group_correlation(_written_weights(spark, sf_dir), _groups(spark, sf_dir), ordered=False)
    return H.top_terms(grid.withColumn("correlation", F.round("correlation", 5)), 10)


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        read_comments, read_users, user_names, read_people, read_threads, flatten_nested, write_user_types,
        collect_users, collect_comments, collect_history,
        write_group_stats, write_word_counts,
        crawl_plan, hot_top_n, select_submissions, drop_authorless, authorless, flatten_threads, user_history,
        merge_users, merge_comments, merge_comments_keep_parent, normalise_nulls, format_created, check_integrity,
        stream_merge_comments, stream_merge_users,
        unbold, type_from_flair, lookup, count_by_type, match_counts, rows_with_k_matches, last_match,
        comments_with_user_type, types_per_user, ambiguous_users, unambiguous_type, rename_sources,
        project_user_types, project_comments, preview,
        embed, pairwise_inner, pairwise_top_k, label_vectors, project_2d, plot_table, tidy_comment,
        split_posts, posts_count, posts_without_urls, urls_count, punctuations_count, emojis_count,
        emojis_count_documented, count_means, dichotomies, type_counts, profile, person_features,
        group_stats, dichotomy_stats, summary, rank_groups, group_content,
        clean_text, tokenize, remove_stopwords, noun_lemmas, lemmatize, clean_preview, clean_groups,
        vocabulary, word_occurrences, occurrence_histogram, rare_words, rarity_summary, remove_rare_words,
        tf, df_idf, tfidf, tfidf_per_person, tfidf_matrix, term_correlation, group_indicators,
        term_group_correlation, term_group_correlation_sparse, top_terms,
    )
}
QUERIES["stats_and_tokens_per_person"] = _stats_and_tokens("person")
QUERIES["stats_and_tokens_per_type"] = _stats_and_tokens("type")
QUERIES["stats_and_tokens_per_letter"] = _stats_and_tokens("letter")
QUERIES["extract_all"] = _matches
QUERIES["attach_comment_type"] = _attached
QUERIES["resolve_type"] = _typed_users
QUERIES |= {f"declaration_{name}": _declaration(name) for name, _, _ in P.DECLARATIONS}
QUERIES |= {f"step_{name}": _step(name) for name in _STEPS}

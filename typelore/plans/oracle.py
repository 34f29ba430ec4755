"""The same answers in plain SQL over the given tables, written step by step and without the shortcuts of the jobs."""

from __future__ import annotations

from typelore.functions import patterns as P
from typelore.operators.ingest import REQUIRED
from typelore.operators.merge import COMMENT_COLUMNS, FIRST_WINS
from typelore.operators.groups import MEANS
from typelore.plans import given
from typelore.plans.registry import CORRELATED_TERMS, MATRIX_TERMS, MIN_INNER, TOP_INNER
from typelore.sources.crawl_plan import CRAWL_PLAN


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---- text steps; this dialect of regular expressions has no look-around ------------------------------------------------

_BLANK = P.BLANK_CHAR + r"\x0b"
_URL = (
    r"https?://(www\.)?[-a-zA-Z0-9@:%._+~#=]{2,256}\.[a-z]{2,4}\b([-a-zA-Z0-9@:%_+.~#?&/=]*)"
)
# no emoji starts with a character that may end one, so the end can be taken along and put back
_EMOJI_END = rf"([{_BLANK}]|[!.?]|$)"
_EMOJI = {
    "effective": rf"(:[\p{{L}}\p{{N}}_]+:|<[/\]?3|\[()\\D*$][-^]?[:;=]|[:;=B8][-^]?[3DOPp@$*\\)(/|])" + _EMOJI_END,
    "documented": rf"(:[\p{{L}}\p{{N}}_]+:|<[/\\]?3|[()\\|*$][-^]?[:;=]|[:;=B8][-^]?[3DOPp@$*\\)(/|])" + _EMOJI_END,
}


def _replace(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, {_quote(pattern)}, {_quote(by)}, 'g')"


_STEPS = {
    "remove_urls": lambda t: _replace(t, _URL),
    "remove_emojis": lambda t: _replace(t, _EMOJI["effective"], r"\2"),
    "remove_punctuation": lambda t: _replace(t, r"[.!?\\-]"),
    "lower": lambda t: f"lower({t})",
    "special_to_blank": lambda t: _replace(t, r"[^\p{L}\p{N}]", " "),
    "remove_digits": lambda t: _replace(t, "[0-9]"),
    "collapse_blanks": lambda t: _replace(t, " +", " "),
    "trim": lambda t: f"trim({t})",
}


def _clean(text: str, last: str = "trim") -> str:
    for name, step in _STEPS.items():
        text = step(text)
        if name == last:
            break
    return text


def _words(cleaned: str) -> str:
    """List of words, contractions split in two."""
    halves = " ".join(f"WHEN {_quote(a + b)} THEN [{_quote(a)}, {_quote(b)}]" for a, b in P.CONTRACTIONS)
    split = f"list_filter(string_split({cleaned}, ' '), lambda w: w <> '')"
    return f"flatten(list_transform({split}, lambda w: CASE w {halves} ELSE [w] END))"


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {_quote(pattern)}))"


_LETTERS = ", ".join(
    f"CASE WHEN substr(type, {at}, 1) = '{one}' THEN '{one}' ELSE '{zero}' END" for _, one, zero, at in P.DICHOTOMIES
)
_GROUPS = f"[type, {_LETTERS}]"

_DECLARED = {
    f"{name}__on__{field}": f"nullif(regexp_extract({field}, {_quote(pattern)}, {group}), '')"
    for name, pattern, group in P.DECLARATIONS
    for field in ("title", "content")
}
_STOPWORDS = ", ".join(_quote(w) for w in P.STOPWORDS)
_PLAN = ", ".join(
    f"({_quote(t.subreddit)}, {t.n_hot}, "
    + ("NULL" if t.flairs is None else "[" + ", ".join(_quote(f) for f in t.flairs) + "]")
    + ")"
    for t in CRAWL_PLAN
)
_COUNTS = ("urls_count", "punctuations_count", "emojis_count")
_MEAN_AVGS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in MEANS)
_TIME = "strftime(make_timestamp(CAST(created_utc AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S')"

_MERGED = ", ".join(
    f"arg_{'min' if c in FIRST_WINS else 'max'}_null({c}, seq) AS {c}" for c in COMMENT_COLUMNS if c != "id"
)

# view: (views it reads, statement)
_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "base": ((), given.BASE),
    "items": (("base",), given.ITEMS),
    "deliveries": (("items",), given.DELIVERIES),
    "submissions": ((), given.SUBMISSIONS),
    "history": ((), given.HISTORY),
    "people": ((), given.PEOPLE),
    "plan": ((), f"SELECT * FROM (VALUES {_PLAN}) AS v(subreddit, n_hot, flairs)"),
    "hot": (
        ("submissions", "plan"),
        """SELECT s.*, p.flairs FROM submissions s JOIN plan p USING (subreddit)
           QUALIFY row_number() OVER (PARTITION BY s.subreddit ORDER BY hot_rank, id) <= n_hot""",
    ),
    "comments": (("items",), f"SELECT *, {_TIME} AS created_datetime FROM items WHERE user_id IS NOT NULL"),
    "users": (
        ("items",),
        """SELECT user_id AS id, arg_min(user_name, seq) AS name,
             coalesce(arg_min(user_flair_text, seq) FILTER (user_flair_text <> ''),
                      arg_max_null(user_flair_text, seq)) AS flair_text
           FROM items WHERE user_id IS NOT NULL GROUP BY user_id""",
    ),
    "flair_types": (
        ("users",),
        f"""SELECT id, name, flair_text, nullif(regexp_extract(
              translate(upper(flair_text), '{P.BOLD_CAPITALS}', '{P.CAPITALS}'), '{P.TYPE}'), '') AS mbti_type
            FROM users""",
    ),
    "matches": (
        ("comments",),
        "SELECT id, user_id, " + ", ".join(f"{e} AS {c}" for c, e in _DECLARED.items()) + " FROM comments",
    ),
    "extracted": (
        ("matches",),
        f"SELECT id, user_id, coalesce({', '.join(reversed(_DECLARED))}) AS extracted_mbti FROM matches",
    ),
    "user_sets": (
        ("extracted",),
        """SELECT user_id, list_sort(list(DISTINCT extracted_mbti)) AS types FROM extracted
           WHERE extracted_mbti IS NOT NULL GROUP BY user_id""",
    ),
    "resolved": (
        ("flair_types", "user_sets"),
        """SELECT u.id, u.name, u.flair_text, u.mbti_type AS mbti_type_from_flair_text,
             s.types[1] AS mbti_type_from_comments, coalesce(u.mbti_type, s.types[1]) AS mbti_type
           FROM flair_types u LEFT JOIN user_sets s ON u.id = s.user_id AND len(s.types) = 1""",
    ),
    "posts": (
        ("people",),
        """SELECT person_id, type, unnest(range(len(parts))) AS post_no, unnest(parts) AS post
           FROM (SELECT *, string_split(posts, '|||') AS parts FROM people)""",
    ),
    "counted": (
        ("posts",),
        f"""SELECT *, {_count('plain', P.PUNCTUATION)} AS p, {_count('plain', _EMOJI['effective'])} AS e,
              {_count('plain', _EMOJI['documented'])} AS ed
            FROM (SELECT *, {_count('post', _URL)} AS u, {_STEPS['remove_urls']('post')} AS plain FROM posts)""",
    ),
    "features": (
        ("counted",),
        """SELECT person_id, type, count(*)::INT AS posts_count, sum(u)::INT AS urls_count,
             sum(p)::INT AS punctuations_count, sum(e)::INT AS emojis_count, sum(ed)::INT AS documented,
             sum(u) / count(*) AS mean_url_count, sum(p) / count(*) AS mean_punctuation_count,
             sum(e) / count(*) AS mean_emoji_count
           FROM counted GROUP BY person_id, type""",
    ),
    "group_rows": (("features",), f"SELECT unnest({_GROUPS}) AS \"group\", * FROM features"),
    "all_words": (
        ("posts",),
        f"""SELECT person_id, type, post_no, unnest(range(len(words))) AS pos, unnest(words) AS token
            FROM (SELECT *, {_words('cleaned')} AS words FROM (SELECT *, {_clean('post')} AS cleaned FROM posts))""",
    ),
    "tokens": (("all_words",), f"SELECT * FROM all_words WHERE token NOT IN ({_STOPWORDS})"),
    "raw_words": (("tokens",), "SELECT DISTINCT token FROM tokens"),
    "lemma_tokens": (
        ("tokens", "lemmas"),
        "SELECT t.* REPLACE (coalesce(lemma, token) AS token) FROM tokens t LEFT JOIN lemmas ON form = token",
    ),
    "counts": (("lemma_tokens",), "SELECT token, count(*) AS occurrences FROM lemma_tokens GROUP BY token"),
    "group_words": (
        ("lemma_tokens",), f"SELECT unnest({_GROUPS}) AS \"group\", person_id, post_no, pos, token FROM lemma_tokens"
    ),
    "all_groups": (("people",), f"SELECT DISTINCT unnest({_GROUPS}) AS \"group\" FROM people"),
    "tf": (
        ("group_words",),
        """SELECT "group", token AS term, count(*) AS tf FROM group_words WHERE length(token) >= 2
           GROUP BY "group", token""",
    ),
    "idf": (
        ("tf", "all_groups"),
        """SELECT term, count(*) AS df, ln((1 + n) / (1 + count(*))) + 1 AS idf
           FROM tf, (SELECT count(*) AS n FROM all_groups) GROUP BY term, n""",
    ),
    "weights": (
        ("tf", "idf"),
        """SELECT "group", term, w / sqrt(sum(w * w) OVER (PARTITION BY "group")) AS tfidf
           FROM (SELECT "group", term, tf * idf AS w FROM tf JOIN idf USING (term))""",
    ),
    "person_tf": (
        ("lemma_tokens",),
        """SELECT person_id AS "group", token AS term, count(*) AS tf FROM lemma_tokens WHERE length(token) >= 2
           GROUP BY person_id, token""",
    ),
    "sums": (
        ("weights", "all_groups"),
        """SELECT term, sum(tfidf) AS sx, sum(tfidf * tfidf) AS sxx,
             (SELECT count(*) FROM all_groups)::DOUBLE AS n FROM weights GROUP BY term""",
    ),
    "grid": (
        ("weights", "sums"),
        """SELECT s.term, g."group", coalesce(w.tfidf, 0) AS x, sx, sxx, n
           FROM sums s CROSS JOIN all_groups g
           LEFT JOIN weights w ON w.term = s.term AND w."group" = g."group\"""",
    ),
    "correlated": (
        ("grid",),
        """SELECT term, "group", round((n * x - sx) / sqrt((n * sxx - sx * sx) * (n - 1)), 5) AS correlation
           FROM grid""",
    ),
    "landed": ((), given.THREADS),
    "lines": (
        ("landed",),
        """SELECT *, number + k AS num, CASE WHEN author_id IS NOT NULL THEN id END AS root
           FROM (SELECT *, unnest(range(len(parts))) AS k, unnest(parts) AS line
                 FROM (SELECT *, string_split(text, chr(10)) AS parts FROM landed))""",
    ),
    "nodes": (
        ("lines",),
        """SELECT *, k % 5 = 3 AS more, k % 5 <> 3 AND num % 6 <> 5 AS authored,
             CASE WHEN (k - 1) % 5 = 3 THEN k - 2 ELSE k - 1 END AS above FROM lines""",
    ),
    "flat": (
        ("landed", "nodes"),
        """SELECT id, author_id AS user_id, author_name AS user_name, author_flair_text AS user_flair_text,
             id AS parent_submission_id, NULL::VARCHAR AS parent_comment_id, title, selftext AS content, created_utc,
             score AS upvotes, subreddit, link_flair_text AS submission_flair_text, hot_rank AS rank, 0 AS place
           FROM landed
           UNION ALL
           SELECT n.id || '_' || n.k, CASE WHEN n.authored THEN 'u' || n.num % 11 END,
             CASE WHEN n.authored THEN 'name_' || n.num % 11 END,
             CASE n.k % 3 WHEN 1 THEN 'ENTJ' WHEN 2 THEN 'ISTP' END, n.id,
             CASE WHEN n.above < 0 THEN n.root WHEN p.authored THEN p.id || '_' || p.k END, NULL, n.line,
             1612137600 + n.num, n.num % 50, n.subreddit, n.link_flair_text, n.hot_rank,
             row_number() OVER (PARTITION BY n.id ORDER BY n.k) AS place
           FROM (SELECT * FROM nodes WHERE NOT more) n LEFT JOIN nodes p ON p.id = n.id AND p.k = n.above""",
    ),
    "hot_landed": (
        ("landed", "plan"),
        """SELECT l.id FROM landed l JOIN plan p USING (subreddit) WHERE is_self AND num_comments > 0
             AND (link_flair_text IS NULL OR (flairs IS NOT NULL AND list_contains(flairs, link_flair_text)))
             AND l.id IN (SELECT id FROM landed JOIN plan USING (subreddit)
               QUALIFY row_number() OVER (PARTITION BY subreddit ORDER BY hot_rank, id) <= n_hot)""",
    ),
    "collected": (
        ("flat", "hot_landed"),
        """SELECT *, lpad(rank::VARCHAR, 12, '0') || parent_submission_id || lpad(place::VARCHAR, 9, '0') AS seq FROM flat
           WHERE user_id IS NOT NULL AND parent_submission_id IN (SELECT id FROM hot_landed)""",
    ),
    "comment_words": (
        ("comments",),
        f"SELECT id, unnest(string_split({_clean('content')}, ' ')) AS word FROM comments",
    ),
    "slots": (
        ("comment_words",),
        """SELECT id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % 64 AS slot, count(*) AS c
           FROM comment_words WHERE word <> '' GROUP BY ALL""",
    ),
    "candidates": (
        ("raw_words",),
        "SELECT token AS form, token AS lemma, 0 AS place FROM raw_words"
        + "".join(
            f" UNION ALL SELECT token, substr(token, 1, length(token) - {len(end)}) || '{new}', {i + 1} FROM raw_words"
            f" WHERE suffix(token, '{end}')"
            for i, (end, new) in enumerate(P.NOUN_ENDINGS)
        ),
    ),
    "lemmas": (
        ("candidates",),
        """SELECT form, arg_min(lemma, length(lemma) * 100 + place) AS lemma FROM candidates
           WHERE lemma IN (SELECT token FROM raw_words WHERE length(token) > 2) GROUP BY form""",
    ),
}


def _needed(names: tuple[str, ...], found: dict[str, None]) -> dict[str, None]:
    for name in names:
        if name not in found:
            _needed(_VIEWS[name][0], found)
            found[name] = None
    return found


def _with(views: str, body: str) -> str:
    ctes = ",\n".join(f"{name} AS ({_VIEWS[name][1]})" for name in _needed(tuple(views.split()), {}))
    return f"WITH {ctes}\n{body}"


def _steps() -> dict[str, str]:
    return {
        f"step_{name}": _with("posts", f"SELECT person_id, post_no::INT AS post_no, {_clean('post', name)} AS text FROM posts")
        for name in _STEPS
    }


def _declarations() -> dict[str, str]:
    return {
        f"declaration_{name}": _with("matches", f"SELECT id, {name}__on__title, {name}__on__content FROM matches")
        for name, _, _ in P.DECLARATIONS
    }


def _violations() -> str:
    def line(label: str, query: str) -> str:
        return f"SELECT '{label}' AS \"check\", ({query})::BIGINT AS violations"

    source = {"comments": "raw", "users": "users"}
    lines = [
        line(f"{t}.{c} not null", f"SELECT count(*) FROM {source[t]} WHERE {c} IS NULL")
        for t, columns in REQUIRED.items()
        for c in columns
    ]
    lines += [
        line(f"{t}.id unique", f"SELECT count(*) - count(DISTINCT id) FROM {source[t]}") for t in REQUIRED
    ]
    lines.append(
        line(
            "comments.user_id in users.id",
            "SELECT count(*) FROM raw WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT id FROM users)",
        )
    )
    lines.append(
        line(
            "comments.parent_comment_id in comments.id",
            "SELECT count(*) FROM raw WHERE parent_comment_id IS NOT NULL"
            " AND parent_comment_id NOT IN (SELECT id FROM raw)",
        )
    )
    return f", raw AS (SELECT *, created_utc AS created_datetime FROM deliveries)\n" + " UNION ALL ".join(lines)


def _profile() -> str:
    columns = {
        "id": "string", "user_id": "string", "user_name": "string", "user_flair_text": "string",
        "parent_submission_id": "string", "parent_comment_id": "string", "title": "string", "content": "string",
        "created_utc": "bigint", "upvotes": "bigint", "subreddit": "string", "submission_flair_text": "string",
        "seq": "bigint",
    }
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS non_null, '{t}' AS dtype FROM items" for c, t in columns.items()
    )


def _stats_tokens(grain: str) -> str:
    if grain == "person":
        return _with(
            "features lemma_tokens",
            f"""SELECT f.person_id, f.type, posts_count, {', '.join(f'round({m}, 6) AS {m}' for m in MEANS)}, token,
                  count(*) AS occurrences
                FROM lemma_tokens t JOIN features f USING (person_id) GROUP BY ALL""",
        )
    where = "length(s.\"group\") = 4" if grain == "type" else "length(s.\"group\") = 1"
    return _with(
        "group_rows group_words",
        f"""SELECT s.*, token, occurrences FROM (
              SELECT "group", count(*) AS individuals, sum(posts_count)::BIGINT AS posts, {_MEAN_AVGS}
              FROM group_rows GROUP BY "group") s
            JOIN (SELECT "group", token, count(*) AS occurrences FROM group_words GROUP BY ALL) w USING ("group")
            WHERE {where}""",
    )


_STAT_ROWS = f"""SELECT "group", count(*) AS individuals, sum(posts_count)::BIGINT AS posts, {_MEAN_AVGS}
FROM group_rows GROUP BY "group\""""
_COMMENT_LIST = ", ".join(COMMENT_COLUMNS)
_MERGE = f"""SELECT id, {_MERGED} FROM (SELECT *, {_TIME} AS created_datetime FROM deliveries) GROUP BY id"""
_MATCHED = ", ".join(_DECLARED)
_FOUND = " + ".join(f"({c} IS NOT NULL)::INT" for c in _DECLARED)
_TIDY = _replace("content", r"(?m)^[ \t]*(?:>|&gt;)[^\n]*(?:\n|\z)")
_TIDY = _replace(_TIDY, r"\[View Poll\](?:\([^)\s]*\))?")
_TIDY = _replace(_replace(_TIDY, _URL), r"\bbc\b", "because")

ORACLE: dict[str, str] = {
    "read_comments": _with("comments", f"SELECT {_COMMENT_LIST} FROM comments"),
    "read_users": _with("users", "SELECT * FROM users"),
    "user_names": _with("users", "SELECT name FROM users"),
    "read_people": _with("people", "SELECT * FROM people"),
    "read_threads": _with(
        "landed",
        """SELECT id, subreddit, hot_rank, is_self, num_comments, link_flair_text, author_id, title, selftext, created_utc,
             score FROM landed""",
    ),
    "flatten_nested": _with("flat", "SELECT * FROM flat"),
    "collect_users": _with(
        "collected",
        """SELECT user_id AS id, arg_min(user_name, seq) AS name,
             coalesce(arg_min(user_flair_text, seq) FILTER (user_flair_text <> ''),
                      arg_max_null(user_flair_text, seq)) AS flair_text
           FROM collected GROUP BY user_id""",
    ),
    "collect_comments": _with(
        "collected",
        f"""SELECT id, user_id, parent_submission_id, parent_comment_id, title, content, {_TIME} AS created_datetime, upvotes,
              subreddit, submission_flair_text FROM collected""",
    ),
    "collect_history": _with(
        "deliveries history",
        """SELECT id, arg_min(user_id, arrived) AS user_id, arg_min_null(parent_submission_id, arrived) AS parent_submission_id,
             arg_max_null(parent_comment_id, arrived) AS parent_comment_id, arg_max_null(title, arrived) AS title
           FROM (SELECT id, user_id, parent_submission_id, parent_comment_id, title, seq AS arrived FROM deliveries
             UNION ALL
             SELECT 'c' || substr(id, 2) || '_0', user_id, CASE kind WHEN 'submission' THEN id ELSE parent_submission_id END,
               NULL, CASE kind WHEN 'submission' THEN title END, 2000000000000 + hot_rank
             FROM (SELECT * FROM history
               QUALIFY row_number() OVER (PARTITION BY user_id, kind ORDER BY hot_rank, id) <= 3))
           GROUP BY id""",
    ),
    "write_user_types": _with("resolved", "SELECT id, name, mbti_type FROM resolved"),
    "write_group_stats": _with("group_rows", _STAT_ROWS),
    "write_word_counts": _with("counts", "SELECT * FROM counts"),
    "stats_and_tokens_per_person": _stats_tokens("person"),
    "stats_and_tokens_per_type": _stats_tokens("type"),
    "stats_and_tokens_per_letter": _stats_tokens("letter"),
    "crawl_plan": _with(
        "plan submissions",
        """SELECT subreddit, n_hot, array_to_string(flairs, ';') AS flairs, count(s.id) AS landed
           FROM plan LEFT JOIN submissions s USING (subreddit) GROUP BY subreddit, n_hot, flairs""",
    ),
    "hot_top_n": _with("hot", "SELECT id, subreddit, hot_rank FROM hot"),
    "select_submissions": _with(
        "hot",
        """SELECT id, subreddit, link_flair_text, num_comments FROM hot WHERE is_self AND num_comments > 0
             AND (link_flair_text IS NULL OR (flairs IS NOT NULL AND list_contains(flairs, link_flair_text)))""",
    ),
    "drop_authorless": _with(
        "items", "SELECT id, user_id, parent_comment_id FROM items WHERE user_id IS NOT NULL"
    ),
    "authorless": _with("items", "SELECT id, parent_comment_id FROM items WHERE user_id IS NULL"),
    "flatten_threads": _with(
        "items",
        """SELECT c.id, c.user_id, c.parent_submission_id, CASE WHEN p.user_id IS NOT NULL THEN p.id END
             AS parent_comment_id, c.title, c.content
           FROM items c LEFT JOIN items p ON c.parent_comment_id = p.id WHERE c.user_id IS NOT NULL""",
    ),
    "user_history": _with(
        "history",
        """SELECT id, user_id, kind, hot_rank,
             CASE kind WHEN 'submission' THEN id ELSE parent_submission_id END AS parent_submission_id,
             NULL::VARCHAR AS parent_comment_id, CASE kind WHEN 'submission' THEN title END AS title
           FROM history QUALIFY row_number() OVER (PARTITION BY user_id, kind ORDER BY hot_rank, id) <= 3""",
    ),
    "merge_users": _with("users", "SELECT * FROM users"),
    "merge_comments": _with("deliveries", _MERGE),
    "merge_comments_keep_parent": _with(
        "deliveries",
        """SELECT id, arg_max(parent_comment_id, seq) AS parent_comment_id, arg_min(user_id, seq) AS user_id,
             arg_max(upvotes, seq) AS upvotes FROM deliveries GROUP BY id""",
    ),
    "normalise_nulls": _with(
        "items",
        "SELECT id, CASE WHEN submission_flair_text <> '' THEN submission_flair_text END AS submission_flair_text"
        " FROM items",
    ),
    "format_created": _with("items", f"SELECT id, {_TIME} AS created_datetime FROM items"),
    "check_integrity": _with("deliveries users", "") + _violations(),
    "stream_merge_comments": _with("deliveries", _MERGE),
    "stream_merge_users": _with("users", "SELECT * FROM users"),
    "unbold": _with(
        "items",
        f"""SELECT user_id AS id, seq, translate(user_flair_text, '{P.BOLD_CAPITALS}', '{P.CAPITALS}') AS flair_text
            FROM items WHERE user_id IS NOT NULL""",
    ),
    "type_from_flair": _with(
        "items",
        f"""SELECT user_id AS id, seq, nullif(regexp_extract(
              translate(upper(user_flair_text), '{P.BOLD_CAPITALS}', '{P.CAPITALS}'), '{P.TYPE}'), '') AS mbti_type
            FROM items WHERE user_id IS NOT NULL""",
    ),
    "lookup": _with("comments", "SELECT id, user_id, title, content FROM comments WHERE user_id = 'u7'"),
    "count_by_type": _with(
        "resolved",
        "SELECT mbti_type, count(id) AS users FROM resolved WHERE mbti_type IS NOT NULL GROUP BY mbti_type",
    ),
    "extract_all": _with("matches", f"SELECT id, {_MATCHED} FROM matches"),
    "match_counts": _with(
        "matches", " UNION ALL ".join(f"SELECT '{c}' AS pattern, count({c}) AS matches FROM matches" for c in _DECLARED)
    ),
    "rows_with_k_matches": _with("matches", f"SELECT id, {_MATCHED} FROM matches WHERE {_FOUND} = 2"),
    "last_match": _with("extracted", "SELECT id, extracted_mbti FROM extracted"),
    "comments_with_user_type": _with(
        "extracted flair_types",
        """SELECT c.id AS id_x, c.user_id, c.extracted_mbti, u.id AS id_y, u.mbti_type
           FROM extracted c JOIN flair_types u ON c.user_id = u.id""",
    ),
    "types_per_user": _with("user_sets", "SELECT user_id, array_to_string(types, ',') AS types FROM user_sets"),
    "ambiguous_users": _with(
        "user_sets", "SELECT user_id, array_to_string(types, ',') AS types FROM user_sets WHERE len(types) > 1"
    ),
    "unambiguous_type": _with(
        "user_sets", "SELECT user_id, types[1] AS extracted_mbti FROM user_sets WHERE len(types) = 1"
    ),
    "attach_comment_type": _with(
        "flair_types user_sets",
        """SELECT u.*, s.user_id, s.types[1] AS extracted_mbti
           FROM flair_types u LEFT JOIN user_sets s ON u.id = s.user_id AND len(s.types) = 1""",
    ),
    "rename_sources": _with(
        "flair_types user_sets",
        """SELECT u.id, u.name, u.flair_text, u.mbti_type AS mbti_type_from_flair_text, s.user_id,
             s.types[1] AS mbti_type_from_comments
           FROM flair_types u LEFT JOIN user_sets s ON u.id = s.user_id AND len(s.types) = 1""",
    ),
    "resolve_type": _with("resolved", "SELECT * FROM resolved"),
    "project_user_types": _with("resolved", "SELECT id, name, mbti_type FROM resolved"),
    "project_comments": _with(
        "comments", "SELECT id, user_id, parent_comment_id, subreddit, title, content FROM comments"
    ),
    "preview": _with("comments", "SELECT id, user_id, content FROM comments ORDER BY id LIMIT 5"),
    "embed": _with(
        "slots",
        """SELECT id, slot::INT AS slot, round(c / sqrt(sum(c * c) OVER (PARTITION BY id)), 4) AS value FROM slots""",
    ),
    "pairwise_inner": f"""SELECT a.vec_id AS i, b.vec_id AS j, round(list_inner_product(a.e, b.e), 5) AS value
        FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a
        JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b
          ON a.vec_id < b.vec_id AND list_inner_product(a.e, b.e) >= {MIN_INNER}""",
    "pairwise_top_k": f"""SELECT i, rank::INT AS rank, j, round(value, 5) AS value FROM (
        SELECT a.vec_id AS i, b.vec_id AS j, list_inner_product(a.e, b.e) AS value,
          row_number() OVER (PARTITION BY a.r ORDER BY list_inner_product(a.e, b.e) DESC, b.vec_id, b.r) AS rank
        FROM (SELECT vec_id, embedding::DOUBLE[] AS e, row_number() OVER () AS r FROM embeddings WHERE embedding IS NOT NULL) a
        JOIN (SELECT vec_id, embedding::DOUBLE[] AS e, row_number() OVER () AS r FROM embeddings WHERE embedding IS NOT NULL) b
          ON a.r <> b.r AND len(a.e) = len(b.e)
      ) WHERE rank <= {TOP_INNER}""",
    "label_vectors": _with(
        "comments resolved",
        "SELECT c.id, u.mbti_type AS label, 64 AS dim FROM comments c JOIN resolved u ON c.user_id = u.id",
    ),
    "tidy_comment": _with("comments", f"SELECT id, {_TIDY} AS content FROM comments"),
    "split_posts": _with("posts", "SELECT person_id, post_no::INT AS post_no, post FROM posts"),
    "posts_count": _with("features", "SELECT person_id, posts_count FROM features"),
    "posts_without_urls": _with("counted", "SELECT person_id, post_no::INT AS post_no, plain AS post FROM counted"),
    "urls_count": _with("features", "SELECT person_id, urls_count FROM features"),
    "punctuations_count": _with("features", "SELECT person_id, punctuations_count FROM features"),
    "emojis_count": _with("features", "SELECT person_id, emojis_count FROM features"),
    "emojis_count_documented": _with("features", "SELECT person_id, documented AS emojis_count FROM features"),
    "count_means": _with(
        "features", f"SELECT person_id, {', '.join(f'round({m}, 6) AS {m}' for m in MEANS)} FROM features"
    ),
    "dichotomies": _with(
        "people",
        "SELECT person_id, type, "
        + ", ".join(f"(substr(type, {at}, 1) = '{one}')::INT AS {flag}" for flag, one, _, at in P.DICHOTOMIES)
        + " FROM people",
    ),
    "type_counts": _with("people", "SELECT type, count(*) AS people FROM people GROUP BY type"),
    "profile": _with("items", _profile()),
    "person_features": _with(
        "features",
        f"SELECT person_id, type, posts_count, {', '.join(_COUNTS)}, "
        + ", ".join(f"round({m}, 6) AS {m}" for m in MEANS)
        + ", "
        + ", ".join(f"(substr(type, {at}, 1) = '{one}')::INT AS {flag}" for flag, one, _, at in P.DICHOTOMIES)
        + " FROM features",
    ),
    "group_stats": _with("group_rows", f"SELECT * FROM ({_STAT_ROWS}) WHERE length(\"group\") = 4"),
    "dichotomy_stats": _with("group_rows", f"SELECT * FROM ({_STAT_ROWS}) WHERE length(\"group\") = 1"),
    "summary": _with("group_rows", _STAT_ROWS),
    "rank_groups": _with("group_rows", f"SELECT \"group\", mean_punctuation_count FROM ({_STAT_ROWS})"),
    "group_content": _with(
        "posts", f"SELECT unnest({_GROUPS}) AS \"group\", person_id, post_no::INT AS post_no, post FROM posts"
    ),
    "clean_text": _with("posts", f"SELECT person_id, post_no::INT AS post_no, {_clean('post')} AS cleaned FROM posts"),
    "tokenize": _with("all_words", "SELECT person_id, post_no::INT AS post_no, pos::INT AS pos, token FROM all_words"),
    "remove_stopwords": _with(
        "tokens", "SELECT person_id, post_no::INT AS post_no, pos::INT AS pos, token FROM tokens"
    ),
    "noun_lemmas": _with("lemmas", "SELECT * FROM lemmas"),
    "lemmatize": _with(
        "lemma_tokens", "SELECT person_id, post_no::INT AS post_no, pos::INT AS pos, token FROM lemma_tokens"

    ),
    "clean_preview": _with(
        "posts lemmas",
        f"""SELECT any_value(example) AS example, string_agg(coalesce(lemma, token), ' ' ORDER BY pos) AS tokens
            FROM (SELECT example, unnest(words) AS token, unnest(range(len(words))) AS pos FROM (
              SELECT example, list_filter({_words('cleaned')}, lambda w: w NOT IN ({_STOPWORDS})) AS words FROM (SELECT example, {_clean('example')} AS cleaned FROM (
              SELECT substr(string_agg(post, ' ' ORDER BY person_id, post_no), 1, 174) AS example
              FROM posts WHERE type = 'INFP')))) LEFT JOIN lemmas ON form = token""",
    ),
    "clean_groups": _with(
        "group_words", "SELECT \"group\", person_id, post_no::INT AS post_no, pos::INT AS pos, token FROM group_words"
    ),
    "vocabulary": _with("counts", "SELECT token FROM counts"),
    "word_occurrences": _with("counts", "SELECT * FROM counts"),
    "occurrence_histogram": _with(
        "counts",
        """SELECT b::INT AS bin, count(token) AS words FROM (SELECT unnest(range(1, 11)) AS b)
           LEFT JOIN (SELECT token, least(1 + floor((occurrences - lo) / ((hi - lo) / 10)), 10) AS bin
                      FROM counts, (SELECT min(occurrences) AS lo, max(occurrences) AS hi FROM counts)) ON bin = b
           GROUP BY b""",
    ),
    "rare_words": _with("counts", "SELECT * FROM counts WHERE occurrences < 2"),
    "rarity_summary": _with(
        "counts",
        """SELECT count(*) FILTER (occurrences < 2) AS rare_words,
             round_even(100.0 * count(*) FILTER (occurrences < 2) / count(*), 0)::BIGINT AS percent FROM counts""",
    ),
    "remove_rare_words": _with(
        "lemma_tokens counts",
        """SELECT person_id, post_no::INT AS post_no, pos::INT AS pos, token FROM lemma_tokens
           WHERE token IN (SELECT token FROM counts WHERE occurrences >= 2)""",
    ),
    "tf": _with("tf", "SELECT * FROM tf"),
    "df_idf": _with("idf", "SELECT term, df, round(idf, 6) AS idf FROM idf"),
    "tfidf": _with("weights", "SELECT \"group\", term, round(tfidf, 6) AS tfidf FROM weights"),
    "tfidf_per_person": _with(
        "person_tf people",
        """SELECT "group", term, round(w / sqrt(sum(w * w) OVER (PARTITION BY "group")), 6) AS tfidf
           FROM (SELECT "group", term, tf * (ln((1 + n) / (1 + count(*) OVER (PARTITION BY term))) + 1) AS w
                 FROM person_tf, (SELECT count(DISTINCT person_id) AS n FROM people))""",
    ),
    "tfidf_matrix": _with(
        "weights",
        "SELECT \"group\", "
        + ", ".join(
            f"round(coalesce(sum(tfidf) FILTER (term = '{t}'), 0), 6) AS \"{t}\"" for t in MATRIX_TERMS
        )
        + " FROM weights GROUP BY \"group\"",
    ),
    "term_correlation": _with(
        "grid",
        f"""SELECT g.term, o.term AS other, round(CASE WHEN isnan(corr(g.x, o.x)) THEN NULL ELSE corr(g.x, o.x) END, 5)
              AS correlation
            FROM grid g JOIN grid o USING ("group") WHERE o.term IN ({', '.join(_quote(t) for t in CORRELATED_TERMS)})
            GROUP BY g.term, o.term""",
    ),
    "group_indicators": _with(
        "weights", "SELECT DISTINCT \"group\", \"group\" AS indicator, 1 AS value FROM weights"
    ),
    "term_group_correlation": _with("correlated", "SELECT * FROM correlated"),
    "term_group_correlation_sparse": _with(
        "grid",
        """SELECT term, "group", round((n * x - sx) / sqrt((n * sxx - sx * sx) * (n - 1)), 5) AS correlation,
             round(-sx / sqrt((n * sxx - sx * sx) * (n - 1)), 5) AS correlation_elsewhere
           FROM grid WHERE x > 0""",
    ),
    "top_terms": _with(
        "correlated",
        """SELECT term, "group", correlation, row_number() OVER (PARTITION BY "group"
             ORDER BY correlation DESC NULLS LAST, term)::INT AS rank FROM correlated QUALIFY rank <= 10""",
    ),
    **_steps(),
    **_declarations(),
}

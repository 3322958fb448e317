"""Pseudonyms, redaction, identity gates and the k-anonymity rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import col, floored, suppressed
from ..params import DEFAULT, Params

# Accounts that are no people, and what an identity looks like.
BOT_LOGINS = ("dependabot", "dependabot-preview", "renovate", "renovate-bot", "github-actions", "asfgit", "asf-ci", "codecov")
BOT_PATTERN = r"^apache-.*-bot$|^.*\[bot\]$"
IDENTITY_TOKENS = ("login", "email", "name", "salary")
# What \w and \b mean differs between engines beyond ASCII, so classes and borders are written out.
BORDER = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
EMAIL = BORDER + r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+" + BORDER
MENTION = r"(?<![\w./-])@([A-Za-z0-9](?:[A-Za-z0-9-]{0,38}))"
USER_FIELDS = ("assignee", "reporter", "creator", "watcher", "request participants")
MODELLED_FIELDS = ("status", "resolution", "priority", "issuetype", "component", "fix version", "version", "labels", "sprint")


class IdentityLeak(AssertionError):
    """A table that must not hold identities does."""


def pseudonym(login: str | Column, salt: str) -> Column:
    """V1: first 16 hex digits of the salted SHA-256 of the trimmed, lower-cased login; null for an empty one."""
    handle = F.lower(F.trim(col(login)))
    return F.when(handle != "", F.substring(F.sha2(F.concat(handle, F.lit(salt)), 256), 1, 16))


def pseudonymise(df: DataFrame, login: str, salt: str, into: str = "actor_hash") -> DataFrame:
    """V1: replace a login by its pseudonym; rows without a login are dropped."""
    return df.withColumn(into, pseudonym(login, salt)).where(F.col(into).isNotNull()).drop(login)


def is_bot(login: str | Column, typename: Column | None = None) -> Column:
    """V2: an account that is no person: by type, list or pattern; so is an empty one."""
    handle = F.lower(F.trim(col(login)))
    listed = F.regexp_replace(handle, r"\[bot\]$", "").isin(*BOT_LOGINS)
    typed = F.lit(False) if typename is None else F.coalesce(F.lower(F.trim(typename)) == "bot", F.lit(False))
    return typed | F.coalesce(handle, F.lit("")).eqNullSafe("") | F.coalesce(listed | handle.rlike(BOT_PATTERN), F.lit(False))


def woven(text: Column, pattern: Column, group: int, name: Callable[[Column], Column]) -> Column:
    """The text with each match of the pattern replaced by what `name` makes of the group: cut at the matches and put together again."""
    found, parts = F.regexp_extract_all(text, pattern, F.lit(group)), F.split(text, pattern)
    rest = F.zip_with(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), found, lambda part, match: F.concat(name(match), part))
    return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))


def redact(df: DataFrame, text: str, logins: str, salt: str) -> DataFrame:
    """V3: e-mail addresses go, the record's own logins and mentions become short pseudonyms.

    All logins of a record are searched for in one pass, the longest one first where several begin; a pseudonym does not
    depend on case, so it comes from the match itself. Texts without an @ or a login's characters are not searched.
    """

    def short(login: Column) -> Column:
        return F.substring(pseudonym(login, salt), 1, 8)

    known = F.array_sort(F.filter(F.array_distinct(F.coalesce(F.col(logins), F.array().cast("array<string>"))), lambda x: F.trim(x) != ""), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    mails = F.contains(F.col(text), F.lit("@"))
    out = df.withColumn("_known", known).withColumn("_t", F.when(mails, F.regexp_replace(F.col(text), EMAIL, "<email-redacted>")).otherwise(F.col(text)))
    quoted = F.transform("_known", lambda x: F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    anywhere = F.exists("_known", lambda x: F.contains(F.lower("_t"), F.lower(x)))
    named = woven(F.col("_t"), F.concat(F.lit("(?i)(?<![A-Za-z0-9])(?:"), F.array_join(quoted, "|"), F.lit(")(?![A-Za-z0-9])")), 0, short)
    out = out.withColumn("_t", F.when(anywhere, named).otherwise(F.col("_t")))
    mentioned = woven(F.col("_t"), F.lit(MENTION), 1, lambda m: F.concat(F.lit("@"), short(m)))
    return out.withColumn(text, F.when(F.contains("_t", F.lit("@")), mentioned).otherwise(F.col("_t"))).drop("_t", "_known")


def scrub_person(person: Column, salt: str) -> Column:
    """V4: a person object without its login: type, bot flag and, for people, the pseudonym; null stays null."""
    login, kind = person["login"], person["__typename"]
    bot = is_bot(login, kind)
    return F.when(person.isNotNull(), F.struct(kind.alias("__typename"), bot.alias("is_bot"), F.when(~bot, pseudonym(login, salt)).alias("actor_hash")))


def scrub_payload(prs: DataFrame, salt: str) -> DataFrame:
    """V4: pull requests with person objects scrubbed at every depth, texts redacted and labels flattened to strings.

    Reads title, body, author, mergedBy, labels (nodes of structs with a name), reviews, timelineItems.
    """
    people = F.array_distinct(F.concat(F.array(F.col("author.login"), F.col("mergedBy.login")), F.coalesce(F.transform("reviews.nodes", lambda r: r["author"]["login"]), F.array().cast("array<string>"))))
    prs = prs.withColumn("_logins", F.filter(people, lambda x: x.isNotNull()))
    for text in ("title", "body"):
        prs = redact(prs, text, "_logins", salt)
    reviews = F.transform("reviews.nodes", lambda r: r.withField("author", scrub_person(r["author"], salt)))
    labels = F.coalesce(F.transform("labels.nodes", lambda n: n["name"]), F.array().cast("array<string>"))
    return prs.withColumns({"author": scrub_person(F.col("author"), salt), "mergedBy": scrub_person(F.col("mergedBy"), salt), "reviews": F.struct(reviews.alias("nodes")), "labels": labels}).drop("_logins")


def scrub_changelog(logs: DataFrame, salt: str) -> DataFrame:
    """V5: change histories with authors and user-valued fields as pseudonyms, and values of fields that are not modelled dropped."""

    def item(i: Column) -> Column:
        field = F.lower(F.trim(i["field"]))
        user, modelled = field.isin(*USER_FIELDS), field.isin(*MODELLED_FIELDS)

        def value(name: str) -> Column:
            return F.when(user, pseudonym(i[name], salt)).when(modelled, i[name])

        return F.struct(i["field"].alias("field"), i["fieldtype"].alias("fieldtype"), value("fromString").alias("fromString"), value("toString").alias("toString"), (~(user | modelled)).alias("values_dropped"))

    def history(h: Column) -> Column:
        login = F.coalesce(h["author"]["name"], F.split_part(h["author"]["emailAddress"], F.lit("@"), F.lit(1)))
        bot = is_bot(login)
        author = F.struct(F.when(~bot, pseudonym(login, salt)).alias("actor_hash"), bot.alias("is_bot"))
        return F.struct(h["id"].alias("id"), h["created"].alias("created"), author.alias("author"), F.transform(h["items"], item).alias("items"))

    return logs.withColumn("histories", F.transform("histories", history))


def columns_deep(schema: T.StructType, prefix: str = "") -> list[str]:
    """Names of all columns and fields at any depth."""
    out: list[str] = []
    for f in schema.fields:
        kind = f.dataType
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        out.append(prefix + f.name)
        if isinstance(kind, T.StructType):
            out += columns_deep(kind, f"{prefix}{f.name}.")
    return out


def identity_columns(df: DataFrame, tokens: tuple[str, ...] = IDENTITY_TOKENS) -> list[str]:
    """V6: columns whose name holds a forbidden token."""
    return [c for c in columns_deep(df.schema) if any(t in c.rpartition(".")[2].lower() for t in tokens)]


def string_scan(df: DataFrame, pattern: str) -> DataFrame:
    """V6 and V9: one row per string column: how many of its values match; one aggregate over the table."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, n_matching long")
    row = df.agg(*[F.count(F.when(F.col(f"`{c}`").rlike(pattern), 1)).alias(f"_{i}") for i, c in enumerate(names)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}").alias("n_matching")) for i, c in enumerate(names)])).alias("x")).select("x.*")


def assert_no_identity(df: DataFrame, strict: bool = False) -> DataFrame:
    """V6: raises if a column is named after an identity or, if strict, a string holds an e-mail address; else gives `df` back."""
    if bad := identity_columns(df):
        raise IdentityLeak(f"identity columns: {bad}")
    if strict and (found := [r["column_name"] for r in string_scan(df, EMAIL).where("n_matching > 0").collect()]):
        raise IdentityLeak(f"e-mail addresses in: {found}")
    return df


def identity_map(logins: DataFrame, salt: str) -> DataFrame:
    """V7: each person's pseudonym, first source and first time seen, with the salt's fingerprint; bots are left out."""
    people = logins.where(~is_bot("login")).withColumn("handle", F.lower(F.trim("login")))
    mark = F.substring(F.sha2(F.lit("fingerprint:" + salt), 256), 1, 16)
    return people.groupBy("handle").agg(F.min("first_seen").alias("first_seen"), F.min_by("source", F.struct("first_seen", "source")).alias("source")).select(pseudonym("handle", salt).alias("actor_hash"), "handle", "source", "first_seen", mark.alias("salt_fingerprint"))


def assert_same_salt(stored: DataFrame, salt: str) -> None:
    """V7: raises if the stored map was made with another salt."""
    marks = {r[0] for r in stored.select("salt_fingerprint").distinct().limit(2).collect()}
    now = stored.sparkSession.range(1).select(F.substring(F.sha2(F.lit("fingerprint:" + salt), 256), 1, 16)).first()[0]
    if marks - {now}:
        raise ValueError("the salt differs from the one the identity map was made with")


def suppress(df: DataFrame, n: str, metrics: list[str], p: Params = DEFAULT) -> DataFrame:
    """V8: metrics with fewer than k people behind them become null; the row stays, marked as suppressed."""
    return df.withColumns({m: floored(n, m, p.k) for m in metrics} | {"suppressed": suppressed(n, p.k)})


def assert_published(df: DataFrame, denied: tuple[str, ...] = ("actor_hash", "resource", "redone_by", "author", "login")) -> DataFrame:
    """V9: raises if a published table has a per-person column or a pseudonym in any string; else gives `df` back."""
    if bad := [c for c in columns_deep(df.schema) if c.rpartition(".")[2].lower() in denied]:
        raise IdentityLeak(f"per-person columns: {bad}")
    if found := [r["column_name"] for r in string_scan(df, r"^[0-9a-f]{16}$").where("n_matching > 0").collect()]:
        raise IdentityLeak(f"pseudonyms in: {found}")
    return df

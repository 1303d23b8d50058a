"""Text expressions: slugs, tokens, hashes, excerpts and inline links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lakegraph import model


# Default size of a scan split.
SPLIT_BYTES = 128 * 1024 * 1024


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A one-element ``transform`` binds the value to a lambda variable, so an
    expensive expression used several times is not repeated by the optimizer.
    """
    return F.transform(F.array(value), body)[0]


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later filters and expressions read instead of recomputing.

    A generator is a boundary the optimizer does not move filters or
    expressions across, and it costs no shuffle.
    """
    fields = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(fields)))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores when its input is too small to have a split for each.

    For expensive row-wise work on small inputs; an input of more than one
    scan split per core, by the optimizer's estimate, is left alone.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPLIT_BYTES else df


def slugify(text: Column, max_len: int = 80) -> Column:
    """Lower-case name of letters, digits and single dashes; ``untitled`` if nothing is left."""
    kept = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s\x85\p{Z}.-]", "")
    dashed = F.btrim(F.regexp_replace(kept, r"[\s\x85\p{Z}._-]+", "-"), F.lit("-"))
    named = F.when(dashed == "", F.lit("untitled")).otherwise(dashed)
    return F.rtrim(F.substring(named, 1, max_len), F.lit("-"))


def tokenize(text: Column) -> Column:
    """Index tokens in text order, without stop words."""
    words = F.regexp_extract_all(text, F.lit(model.INDEX_TOKEN), F.lit(0))
    return F.filter(F.transform(words, F.lower), lambda t: ~t.isin(*model.STOP_WORDS))


def query_words(text: Column) -> Column:
    """Words of an intent query: no stop-word removal, two characters or more."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9_]+"), lambda t: F.length(t) >= 2)


def token_counts(tokens: Column) -> Column:
    """``array<struct<token, tf>>`` in token order, counted inside the row.

    The sorted token array is cut at value changes, so a document's term
    frequencies need neither an explode nor a shuffle.
    """
    def runs(s: Column) -> Column:
        return F.filter(
            F.sequence(F.lit(1), F.size(s)),
            lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))),
        )

    def counts(s: Column) -> Column:
        return let(runs(s), lambda starts: F.transform(
            starts,
            lambda start, j: F.struct(
                F.element_at(s, start).alias("token"),
                (F.coalesce(F.get(starts, j + 1), F.size(s) + 1) - start).cast("bigint").alias("tf"),
            ),
        ))

    empty = F.array().cast("array<struct<token:string,tf:bigint>>")
    return F.when(F.size(tokens) > 0, let(F.sort_array(tokens), counts)).otherwise(empty)


def l2_norm(counts: Column) -> Column:
    """Euclidean length of a ``token_counts`` array, 1 for an empty one."""
    squares = F.aggregate(counts, F.lit(0).cast("double"), lambda acc, c: acc + c["tf"] * c["tf"])
    return F.when(squares > 0, F.sqrt(squares)).otherwise(F.lit(1.0))


def term_vector(counts: Column, terms: int = model.VECTOR_TERMS) -> Column:
    """Heaviest terms as ``array<struct<token, weight>>``; equal weights in token order."""
    def weigh(norm: Column) -> Column:
        ranked = F.sort_array(F.transform(
            counts, lambda c: F.struct((-c["tf"]).alias("order"), c["token"].alias("token"))
        ))
        return F.transform(
            F.slice(ranked, 1, terms),
            lambda c: F.struct(c["token"].alias("token"), F.round(-c["order"] / norm, 6).alias("weight")),
        )

    return let(l2_norm(counts), weigh)


def estimate_tokens(length: Column) -> Column:
    """Four characters a token, rounded up; takes a character count."""
    return F.floor((F.coalesce(length, F.lit(0)) + 3) / 4).cast("bigint")


def card_text(title: Column, description: Column, type_: Column, tags: Column, body: Column) -> Column:
    """Text an asset is indexed under."""
    blank = F.lit("")
    return F.concat_ws(
        " ",
        F.coalesce(title, blank), F.coalesce(description, blank), F.coalesce(type_, blank),
        F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " "), F.coalesce(body, blank),
    )


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def excerpt(body: Column) -> Column:
    """Prose lines of a body: no blank lines, no headings."""
    lines = F.filter(
        F.split(strip(body), r"\r?\n"),
        lambda line: (strip(line) != "") & ~line.startswith("#"),
    )
    return F.array_join(lines, "\n")


def bundle_hrefs(text: Column, pattern: str = model.MARKDOWN_LINK, group: int = 2) -> Column:
    """In-bundle link targets of a text, without fragment and query string."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    # The usual pattern needs this in the text, which is found much faster.
    hrefs = F.when(text.contains("]("), found).otherwise(F.array().cast("array<string>")) if pattern == model.MARKDOWN_LINK else found
    bare = F.transform(hrefs, lambda h: F.regexp_replace(h, r"[#?][\s\S]*$", ""))
    return F.filter(bare, lambda h: h.startswith("/") & ~h.startswith("//"))

"""Batch writes. Each returns the new archive, the applied rows and the rejects."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import constants as K
from folioscope.functions import text as X
from folioscope.functions.urls import with_normalized_url
from folioscope.operators.query import expired, live, tag_usage
from folioscope.schema import BOOKMARKS, Archive, Change
from folioscope.session import ensure_checkpoint_dir
from folioscope.sources.archive import with_defaults


def _new_tag_id(normalized_name: Column) -> Column:
    """Id of a tag made by a job: derived from its name, so a rerun makes the same one."""
    return F.concat(F.lit("tag-"), X.sha_prefix(normalized_name, 32))


def _reject(df: DataFrame, key: str, code: Column | str) -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    return df.select(F.col(key).cast("string").alias("key"), code.alias("error_code"))


def _replace_rows(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """`old` with the rows of `new` put in; untouched rows are passed through."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


# --- validation ---------------------------------------------------------------------

_RULES = {
    "url": lambda c: X.utf16_length(c) > K.MAX_URL,
    "title": lambda c: (X.js_trim(c) == "") | (X.utf16_length(X.js_trim(c)) > K.MAX_TITLE),
    "user_note": lambda c: X.utf16_length(c) > K.MAX_NOTE,
    "markdown_content": lambda c: X.utf16_length(c) > K.MAX_MARKDOWN,
    "tag_name": lambda c: (X.tag_display_name(c) == "")
    | (X.utf16_length(X.tag_display_name(c)) > K.MAX_TAG_NAME),
    "tag_names": lambda c: (F.size(c) > K.MAX_TAGS_PER_BOOKMARK)
    | F.exists(c, lambda n: X.utf16_length(X.tag_display_name(n)) > K.MAX_TAG_NAME),
}


def failed_rules(df: DataFrame) -> Column:
    """Names of the fields that break their limits; null fields are not checked."""
    checks = [
        F.when(F.col(name).isNotNull() & broken(F.col(name)), F.lit(name))
        for name, broken in _RULES.items()
        if name in df.columns
    ]
    return F.array_compact(F.array(*checks))


def validate_changes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows within all limits, rejected rows with `failed_fields`)."""
    checked = df.withColumn("failed_fields", failed_rules(df))
    ok = checked.where(F.size("failed_fields") == 0).drop("failed_fields")
    return ok, checked.where(F.size("failed_fields") > 0)


def reject_missing(changes: DataFrame, target: DataFrame, key: str = "bookmark_id") -> DataFrame:
    """NOT_FOUND for changes whose target row does not exist."""
    missing = changes.join(target.select(F.col("id").alias(key)), key, "left_anti")
    return _reject(missing, key, "NOT_FOUND")


def one_per_key(changes: DataFrame, key: str = "bookmark_id") -> tuple[DataFrame, DataFrame]:
    """(at most one change per key, rejects); a key may hold any share of the changes.

    With a column `seq` the newest change of a key counts and the key is reported once as
    SUPERSEDED. Without it nothing orders the changes, so a key that repeats is refused.
    """
    rest = [c for c in changes.columns if c not in (key, "seq")]
    row = F.struct("seq", *rest) if "seq" in changes.columns else F.struct(*rest)
    newest = changes.groupBy(key).agg(F.max(row).alias("_row"), F.count("*").alias("_rows"))
    repeated = newest.where("_rows > 1")
    if "seq" in changes.columns:
        return newest.select(key, "_row.*"), _reject(repeated, key, "SUPERSEDED")
    return (
        newest.where("_rows = 1").select(key, "_row.*"),
        _reject(repeated, key, "VALIDATION_ERROR"),
    )


# --- admission ------------------------------------------------------------------------


def match_existing(requests: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """Add existing_id and match ('live', 'deleted', 'none') by normalized_url."""
    known = bookmarks.select(
        "normalized_url", F.col("id").alias("existing_id"), F.col("deleted_at").alias("_deleted")
    )
    return (
        requests.join(known, "normalized_url", "left")
        .withColumn(
            "match",
            F.when(F.col("existing_id").isNull(), "none")
            .when(F.col("_deleted").isNull(), "live")
            .otherwise("deleted"),
        )
        .drop("_deleted")
    )


def first_per_url(requests: DataFrame) -> DataFrame:
    """request_id of the earliest request per normalized URL.

    A partial aggregate, not a window: a URL asked for by a third of all requests is
    reduced on the map side.
    """
    return (
        requests.where(F.col("normalized_url").isNotNull())
        .groupBy("normalized_url")
        .agg(F.min(F.struct("seq", "request_id")).alias("_first"))
        .select("normalized_url", F.col("_first.request_id").alias("request_id"))
    )


def free_ids(requests: DataFrame, bookmarks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests whose id can become a bookmark id, rejects).

    Of requests with one id the earliest counts (by seq, then by its other columns), and the
    id is refused once for the others. An id that a stored bookmark has is refused, and so is a
    missing one.
    """
    rest = [c for c in requests.columns if c not in ("request_id", "seq")]
    row = F.struct("seq", *rest)
    first = requests.groupBy("request_id").agg(F.min(row).alias("_row"), F.count("*").alias("_n"))
    stored = bookmarks.select(F.col("id").alias("request_id"), F.lit(True).alias("_stored"))
    judged = first.join(stored.distinct(), "request_id", "left").withColumn(
        "_taken", F.coalesce("_stored", F.col("request_id").isNull())
    )
    refused = judged.where("_taken OR _n > 1")
    return (
        judged.where("NOT _taken").select("request_id", "_row.*"),
        _reject(refused, "request_id", "VALIDATION_ERROR"),
    )


def admit(archive: Archive, requests: DataFrame, now: Column) -> Change:
    """Add requested URLs as pending bookmarks.

    requests: request_id (becomes the bookmark id, see free_ids), seq, url, tag_names. Requests
    over the limits are refused first, then those whose id is taken. Four tables follow from
    the verdict on each request, so the verdicts are written once to the checkpoint folder. A
    soft-deleted bookmark of the same URL is removed for good (all of them, if stored URLs
    repeat), see `removed`.
    """
    ensure_checkpoint_dir(requests.sparkSession)
    requests, broken = validate_changes(
        requests.withColumn("request_id", F.col("request_id").cast("string"))
    )
    requests, taken = free_ids(requests, archive.bookmarks)
    checked = with_normalized_url(requests, "url", error="_error", domain="_domain")
    # One row per URL meets the archive; the verdict goes back by the unique request id,
    # so neither join is skewed by a popular URL.
    matched = match_existing(first_per_url(checked), archive.bookmarks)
    winners = matched.groupBy("request_id").agg(F.bool_or(F.col("match") == "live").alias("_live"))
    judged = checked.join(winners, "request_id", "left").withColumn(
        "_code",
        F.when(F.col("_error").isNotNull(), F.col("_error")).when(
            F.coalesce("_live", F.lit(True)), F.lit("DUPLICATE_URL")
        ),
    ).checkpoint()
    fresh = judged.where(F.col("_code").isNull())
    original = X.js_trim(F.col("url"))
    rows = with_defaults(
        fresh.select(
            F.col("request_id").cast("string").alias("id"),
            original.alias("url"),
            "normalized_url",
            F.col("normalized_url").alias("final_url"),
            F.coalesce("_domain", original).alias("title"),
            F.col("_domain").alias("domain"),
            now.alias("created_at"),
            now.alias("updated_at"),
        )
    )
    deleted = archive.bookmarks.where(F.col("deleted_at").isNotNull()).select("id", "normalized_url")
    purged = deleted.join(fresh.select("normalized_url"), "normalized_url", "left_semi").select("id")
    kept = remove_bookmarks(archive, purged)
    added = kept.replace(bookmarks=kept.bookmarks.unionByName(rows))
    tagged = set_tags(
        added,
        fresh.where(F.size("tag_names") > 0).select(
            F.col("request_id").cast("string").alias("bookmark_id"), "tag_names"
        ),
        now,
    )
    refused = judged.where(F.col("_code").isNotNull())
    rejects = (
        _reject(refused, "request_id", F.col("_code"))
        .unionByName(_reject(broken, "request_id", "VALIDATION_ERROR"))
        .unionByName(taken)
        .unionByName(tagged.rejects)
    )
    return Change(tagged.archive, rows, rejects, purged)


def apply_extractions(archive: Archive, extractions: DataFrame, now: Column) -> Change:
    """Fill pending bookmarks with their extraction result (bookmark_id, see one_per_key)."""
    extractions, repeated = one_per_key(extractions)
    result = extractions.select(
        F.col("bookmark_id").alias("id"),
        *[F.col(c).alias(f"_{c}") for c in _EXTRACTED if c in extractions.columns],
    )
    pending = archive.bookmarks.where(F.col("extraction_status") == "pending")
    filled = pending.join(result, "id")
    for c in _EXTRACTED:
        filled = filled.withColumn(c, F.col(f"_{c}") if f"_{c}" in filled.columns else F.lit(None))
    rows = with_defaults(
        filled.withColumn("extracted_at", now).withColumn("updated_at", now)
    )
    rejects = reject_missing(extractions, pending).unionByName(repeated)
    return Change(
        archive.replace(bookmarks=_replace_rows(archive.bookmarks, rows)), rows, rejects
    )


_EXTRACTED = (
    "final_url",
    "title",
    "domain",
    "description",
    "author",
    "favicon_url",
    "cover_image_url",
    "markdown_content",
    "plain_text",
    "content_length",
    "extraction_status",
    "error_code",
    "error_message",
    "http_status_code",
)

# --- edits ------------------------------------------------------------------------------


def edit(archive: Archive, patches: DataFrame, now: Column) -> Change:
    """Apply patches: bookmark_id, title, user_note, markdown_content, tag_names and seq.

    A null field is left alone. Only a real change of the Markdown marks it as edited.
    Patches of one bookmark take effect in the order of `seq`: of each field the last value
    given stays, and the text counts as edited if any of them changed it. Without `seq`, a
    bookmark may have one patch only.
    """
    ok, broken = validate_changes(patches)
    ok, repeated = merged_patches(ok)
    target = live(archive.bookmarks)
    patch = ok.select(
        F.col("bookmark_id").alias("id"),
        *[F.col(c).alias(f"_{c}") for c in ("title", "user_note", "markdown_content")],
        "_least",
        "_most",
        F.lit(True).alias("_patched"),
    )
    # The wide rows meet the patches once; the others are passed through.
    joined = archive.bookmarks.join(patch, "id", "left").withColumn(
        "_patched", F.coalesce("_patched", F.lit(False)) & F.col("deleted_at").isNull()
    )
    # Some text given differs from the stored one if the smallest or the largest does.
    stored = F.sha2("markdown_content", 256)
    changed = F.col("_markdown_content").isNotNull() & (
        (F.col("_least") != stored) | (F.col("_most") != stored)
    )
    touched = F.col("_title").isNotNull() | F.col("_user_note").isNotNull() | changed
    edited_columns = {
        "title": F.coalesce(X.js_trim(F.col("_title")), F.col("title")),
        "user_note": F.coalesce("_user_note", "user_note"),
        "plain_text": F.when(
            changed, X.markdown_to_plain(F.col("_markdown_content"))
        ).otherwise(F.col("plain_text")),
        "content_length": F.when(
            changed, X.content_length(F.col("_markdown_content"))
        ).otherwise(F.col("content_length")),
        "is_content_edited": F.col("is_content_edited") | changed,
        "updated_at": F.when(touched, now).otherwise(F.col("updated_at")),
        "markdown_content": F.when(changed, F.col("_markdown_content")).otherwise(
            F.col("markdown_content")
        ),
    }
    after = joined.withColumns(
        {
            c: F.when(F.col("_patched"), value).otherwise(F.col(c))
            for c, value in edited_columns.items()
        }
    )
    rows = with_defaults(after.where("_patched"))
    edited = archive.replace(bookmarks=after.select(*archive.bookmarks.columns))
    rejects = (
        _reject(broken, "bookmark_id", "VALIDATION_ERROR")
        .unionByName(repeated)
        .unionByName(reject_missing(ok, target))
    )
    if "tag_names" not in patches.columns:
        return Change(edited, rows, rejects)
    wanted = ok.where(F.col("tag_names").isNotNull()).select("bookmark_id", "tag_names")
    tagged = set_tags(
        edited, wanted.join(target.select(F.col("id").alias("bookmark_id")), "bookmark_id", "left_semi"), now
    )
    return Change(tagged.archive, rows, rejects.unionByName(tagged.rejects))


def merged_patches(patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one patch per bookmark_id, rejects), with the extremes of the text's hashes."""
    digest = F.sha2("markdown_content", 256)
    if "seq" not in patches.columns:
        single, repeated = one_per_key(patches)
        return single.withColumns({"_least": digest, "_most": digest}), repeated
    fields = [c for c in patches.columns if c not in ("bookmark_id", "seq")]
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("seq", c)))[c].alias(c)
    merged = patches.groupBy("bookmark_id").agg(
        *[last(c) for c in fields], F.min(digest).alias("_least"), F.max(digest).alias("_most")
    )
    return merged, _reject(merged.where(F.lit(False)), "bookmark_id", "SUPERSEDED")


def re_extract(archive: Archive, results: DataFrame, now: Column) -> Change:
    """Merge new extraction results: bookmark_id, overwrite, then the extracted columns.

    One result per bookmark counts (see one_per_key). Hand-edited text is replaced only with the overwrite flag, and only by a success.
    """
    results, repeated = one_per_key(results)
    target = live(archive.bookmarks)
    result = results.select(
        F.col("bookmark_id").alias("id"),
        F.col("overwrite").alias("_overwrite"),
        *[F.col(c).alias(f"_{c}") for c in _EXTRACTED],
    )
    joined = target.join(result, "id")
    allowed = ~F.col("is_content_edited") | F.col("_overwrite")
    refused = joined.where(~allowed)
    merged = joined.where(allowed)
    status = F.col("_extraction_status")
    keep = (status == "failed") | (F.col("is_content_edited") & (status != "success"))
    old_or_new = lambda c: F.when(F.col("_keep"), F.col(c)).otherwise(F.col(f"_{c}"))
    success = status == "success"
    rows = merged.withColumn("_keep", keep).withColumns(
        {
            "final_url": F.col("_final_url"),
            "title": F.when(success & (F.coalesce("_title", F.lit("")) != ""), F.col("_title")).otherwise(
                F.col("title")
            ),
            "domain": F.coalesce(X.non_empty(F.col("_domain")), F.col("domain")),
            "description": F.coalesce("_description", "description"),
            "author": F.coalesce("_author", "author"),
            "favicon_url": F.coalesce("_favicon_url", "favicon_url"),
            "cover_image_url": F.when(success, F.col("_cover_image_url")).otherwise(
                F.coalesce("_cover_image_url", "cover_image_url")
            ),
            "markdown_content": old_or_new("markdown_content"),
            "plain_text": old_or_new("plain_text"),
            "content_length": old_or_new("content_length"),
            "is_content_edited": F.col("_keep") & F.col("is_content_edited"),
            "retry_count": F.col("retry_count") + 1,
            "extraction_status": status,
            "error_code": F.col("_error_code"),
            "error_message": F.col("_error_message"),
            "http_status_code": F.col("_http_status_code"),
            "extracted_at": now,
            "updated_at": now,
        }
    )
    rows = with_defaults(rows)
    rejects = (
        reject_missing(results, target)
        .unionByName(repeated)
        .unionByName(_reject(refused, "id", "CONTENT_EDITED"))
    )
    return Change(archive.replace(bookmarks=_replace_rows(archive.bookmarks, rows)), rows, rejects)


# --- delete, restore, purge ----------------------------------------------------------------


def cascade(links: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Links that survive the removal of the rows whose ids are in `deleted`."""
    return links.join(deleted.select(F.col("id").alias(key)), key, "left_anti")


def remove_bookmarks(archive: Archive, ids: DataFrame) -> Archive:
    return archive.replace(
        bookmarks=archive.bookmarks.join(ids.select("id"), "id", "left_anti"),
        links=cascade(archive.links, ids, "bookmark_id"),
    )


def _mark(archive: Archive, ids: DataFrame, target: DataFrame, deleted_at: Column) -> Change:
    wanted = ids.select(F.col("bookmark_id").alias("id")).distinct()
    rows = target.join(wanted, "id", "left_semi").withColumn("deleted_at", deleted_at)
    return Change(
        archive.replace(bookmarks=_replace_rows(archive.bookmarks, rows)),
        rows,
        reject_missing(ids, target),
    )


def soft_delete(archive: Archive, ids: DataFrame, now: Column) -> Change:
    """Mark live rows as deleted; updated_at stays as it is."""
    return _mark(archive, ids, live(archive.bookmarks), now)


def restore(archive: Archive, ids: DataFrame) -> Change:
    """Undo a soft delete; updated_at stays as it is."""
    target = archive.bookmarks.where(F.col("deleted_at").isNotNull())
    return _mark(archive, ids, target, F.lit(None).cast("timestamp"))


def purge(archive: Archive, now: Column, minutes: int = K.RETENTION_MINUTES) -> Change:
    """Remove rows whose undo window is over, with their links.

    The expired rows are known from one column, so bookmarks are filtered in place
    and only the links need a join.
    """
    gone = expired(archive.bookmarks, now, minutes).select("id", "deleted_at")
    limit = now - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    kept = archive.bookmarks.where(F.col("deleted_at").isNull() | (F.col("deleted_at") >= limit))
    result = archive.replace(bookmarks=kept, links=cascade(archive.links, gone, "bookmark_id"))
    none = _reject(gone.where(F.lit(False)), "id", "NOT_FOUND")
    return Change(result, gone, none, gone.select("id"))


# --- tags ---------------------------------------------------------------------------------


def with_tag_entries(df: DataFrame) -> DataFrame:
    """Add `entries`, array<struct<position, normalized_name, name>>, from tag_names.

    Equal names keep their first position and their last spelling. All inside the row;
    only lists with characters outside ASCII are handed to Python.
    """
    shown = F.filter(F.transform("tag_names", X.tag_display_name), lambda n: n != "")
    ascii_only = F.forall("_shown", lambda n: n.rlike(r"^[\x00-\x7f]*$"))
    staged = df.withColumn("_shown", shown).withColumn(
        "_foreign", F.when(~ascii_only, F.col("_shown"))
    )
    staged = staged.withColumn("_normal", X.nfkc_lower_lists(F.col("_foreign")))
    staged = staged.withColumn("_normal", F.coalesce("_normal", F.transform("_shown", F.lower)))

    def entry(p: Column) -> Column:
        named = F.arrays_zip(p["_normal"], p["_shown"])
        return F.transform(
            F.array_distinct(p["_normal"]),
            lambda key: F.struct(
                (F.array_position(p["_normal"], key) - 1).cast("int").alias("position"),
                key.alias("normalized_name"),
                F.element_at(F.filter(named, lambda z: z["_normal"] == key), -1)["_shown"].alias(
                    "name"
                ),
            ),
        )

    return staged.withColumn("entries", X.let(F.struct("_normal", "_shown"), entry)).drop(
        "_shown", "_foreign", "_normal"
    )


def distinct_tag_names(df: DataFrame) -> DataFrame:
    """One row per (bookmark_id, normalized_name): first position, last spelling."""
    return with_tag_entries(df).select("bookmark_id", F.inline("entries"))


def resolve_tags(names: DataFrame, tags: DataFrame) -> DataFrame:
    """Distinct names with their tag: existing id, or a new one with is_new = true.

    names: name, normalized_name, and optionally seq. The spelling of a new tag is the
    first one by seq (else the smallest).
    """
    order = "seq" if "seq" in names.columns else "name"
    wanted = names.groupBy("normalized_name").agg(F.min_by("name", order).alias("name"))
    known = tags.select(
        "normalized_name", F.col("id").alias("_id"), F.col("name").alias("_stored")
    )
    return wanted.join(known, "normalized_name", "left").select(
        F.coalesce("_id", _new_tag_id(F.col("normalized_name"))).alias("id"),
        F.coalesce("_stored", "name").alias("name"),
        "normalized_name",
        F.col("_id").isNull().alias("is_new"),
    )


def _new_tags(resolved: DataFrame, now: Column) -> DataFrame:
    return resolved.where("is_new").select(
        "id", "name", "normalized_name", now.alias("created_at"), now.alias("updated_at")
    )


def set_tags(archive: Archive, changes: DataFrame, now: Column) -> Change:
    """Replace the tags of bookmarks: bookmark_id, tag_names and seq (see one_per_key).

    A bookmark that is not stored gets no links but a NOT_FOUND reject.
    """
    changes, repeated = one_per_key(changes)
    missing = reject_missing(changes, archive.bookmarks)
    stored = archive.bookmarks.select(F.col("id").alias("bookmark_id"))
    listed = with_tag_entries(changes.join(stored, "bookmark_id", "left_semi"))
    too_long = F.exists("entries", lambda e: X.utf16_length(e["name"]) > K.MAX_TAG_NAME)
    broken = (F.size("entries") > K.MAX_TAGS_PER_BOOKMARK) | too_long
    refused = listed.where(broken).select("bookmark_id")
    valid = listed.where(~broken)
    changed = valid.select("bookmark_id")
    accepted = valid.select("bookmark_id", F.inline("entries"))
    # The first bookmark naming a new tag decides its spelling.
    spelled = accepted.withColumn("seq", F.struct("bookmark_id", "position"))
    fresh = _new_tags(resolve_tags(spelled, archive.tags), now)
    tags = archive.tags.unionByName(fresh)
    # A new tag's id follows from its name, so the links only need the stored tags.
    known = archive.tags.select("normalized_name", F.col("id").alias("_id"))
    matched = accepted.join(known, "normalized_name", "left")
    linked = matched.select(
        "bookmark_id",
        F.coalesce("_id", _new_tag_id(F.col("normalized_name"))).alias("tag_id"),
        now.alias("created_at"),
    )
    links = archive.links.join(changed, "bookmark_id", "left_anti").unionByName(linked)
    return Change(
        archive.replace(tags=tags, links=links),
        linked,
        _reject(refused, "bookmark_id", "VALIDATION_ERROR")
        .unionByName(missing)
        .unionByName(repeated),
    )


def create_tags(archive: Archive, names: DataFrame, now: Column) -> Change:
    """Create the tags that do not exist yet; names: name (and optionally seq)."""
    ok, broken = validate_changes(names.withColumn("tag_name", F.col("name")))
    shown = ok.withColumn("name", X.tag_display_name(F.col("name"))).withColumn(
        "normalized_name", X.normalize_tag_name(F.col("tag_name"))
    )
    resolved = resolve_tags(shown, archive.tags)
    fresh = _new_tags(resolved, now)
    return Change(
        archive.replace(tags=archive.tags.unionByName(fresh)),
        resolved,
        _reject(broken, "name", "VALIDATION_ERROR"),
    )


def vacated_names(requests: DataFrame, tags: DataFrame) -> DataFrame:
    """(tag_id, name) of the requests that get a name which no stored tag keeps.

    requests: tag_id, name, seq, one per tag, none of them for the tag's present name. A name
    is free from the start if no tag has it, else from the moment its tag has moved to another
    name, and the first request after that takes it. Each round settles the names that became
    free in the round before, so there are as many rounds as renames that wait for each other.
    """
    requests = requests.checkpoint()
    names = tags.select("id", F.col("normalized_name").alias("name"))
    never = F.lit(None).cast(requests.schema["seq"].dataType)
    free = (
        requests.select("name")
        .distinct()
        .join(names, "name", "left_anti")
        .select("name", never.alias("since"))
    )
    taken = None
    while True:
        first = (
            requests.join(free, "name")
            .where(F.col("since").isNull() | (F.col("seq") > F.col("since")))
            .groupBy("name")
            .agg(F.min(F.struct("seq", "tag_id")).alias("first"))
            .select("name", "first.*")
            .checkpoint()
        )
        taken = first if taken is None else taken.unionByName(first)
        if first.isEmpty():
            return taken.select("tag_id", "name")
        moved = first.select(F.col("tag_id").alias("id"), F.col("seq").alias("since"))
        free = names.join(moved, "id").select("name", "since")


def rename_tags(archive: Archive, renames: DataFrame, now: Column) -> Change:
    """Rename tags (tag_id, name and seq, see one_per_key); a name another tag holds is refused.

    With `seq` the renames are applied in its order: a name that an earlier rename gave up is
    free for later ones. Without it nothing orders them, and only names that no stored tag has
    are free. Of several renames to one free name the first wins, then the smallest tag_id.
    """
    ensure_checkpoint_dir(renames.sparkSession)
    ok, broken = validate_changes(renames.withColumn("tag_name", F.col("name")))
    ok, repeated = one_per_key(ok, "tag_id")
    named = ok.select(
        "tag_id",
        F.col("seq") if "seq" in ok.columns else F.lit(0).alias("seq"),
        X.tag_display_name(F.col("name")).alias("_name"),
        X.normalize_tag_name(F.col("name")).alias("_normalized"),
    )
    held = archive.tags.select(F.col("id").alias("tag_id"), F.col("normalized_name").alias("_held"))
    stored = named.join(held, "tag_id")
    same = F.col("_held") == F.col("_normalized")
    moves = stored.where(~same).select("tag_id", F.col("_normalized").alias("name"), "seq")
    moved = vacated_names(moves, archive.tags).select("tag_id", F.lit(True).alias("_wins"))
    judged = stored.join(moved, "tag_id", "left").withColumn(
        "_wins", same | F.coalesce("_wins", F.lit(False))
    )
    accepted = judged.where("_wins").select(F.col("tag_id").alias("id"), "_name", "_normalized")
    rows = archive.tags.join(accepted, "id").select(
        "id",
        F.col("_name").alias("name"),
        F.col("_normalized").alias("normalized_name"),
        "created_at",
        now.alias("updated_at"),
    )
    rejects = (
        _reject(broken, "tag_id", "VALIDATION_ERROR")
        .unionByName(_reject(judged.where("NOT _wins"), "tag_id", "VALIDATION_ERROR"))
        .unionByName(reject_missing(named, archive.tags, "tag_id"))
        .unionByName(repeated)
    )
    return Change(archive.replace(tags=_replace_rows(archive.tags, rows)), rows, rejects)


def delete_tags(archive: Archive, ids: DataFrame) -> Change:
    """Delete tags (column tag_id) with their links."""
    wanted = ids.select(F.col("tag_id").alias("id")).distinct()
    gone = archive.tags.join(wanted, "id", "left_semi")
    return Change(
        archive.replace(
            tags=archive.tags.join(wanted, "id", "left_anti"),
            links=cascade(archive.links, wanted, "tag_id"),
        ),
        gone,
        reject_missing(ids, archive.tags, "tag_id"),
    )


# --- curated sets ----------------------------------------------------------------------------


class CuratedConflict(ValueError):
    """A curated row would touch a row that is not part of the set."""


def curated_conflicts(archive: Archive, bookmarks: DataFrame, tags: DataFrame) -> DataFrame:
    """Rows that forbid the upsert: an id or a URL (or tag id) taken by something else."""
    mine = bookmarks.select("id", F.col("url").alias("_url"))
    by_id = (
        archive.bookmarks.select("id", "normalized_url")
        .join(mine, "id")
        .where(F.col("normalized_url") != F.col("_url"))
        .select("id", F.lit("ID_TAKEN").alias("conflict"))
    )
    by_url = (
        archive.bookmarks.select(F.col("id").alias("_other"), F.col("normalized_url").alias("_url"))
        .join(mine, "_url")
        .where(F.col("_other") != F.col("id"))
        .select("id", F.lit("URL_TAKEN").alias("conflict"))
    )
    by_tag = (
        archive.tags.select("id", F.col("normalized_name").alias("_stored"))
        .join(tags.select("id", "normalized_name"), "id")
        .where(F.col("_stored") != F.col("normalized_name"))
        .select("id", F.lit("TAG_ID_TAKEN").alias("conflict"))
    )
    return by_id.unionByName(by_url).unionByName(by_tag)


def upsert_curated(archive: Archive, bookmarks: DataFrame, tags: DataFrame, now: Column) -> Change:
    """Insert or reset a curated set; nothing is written when anything conflicts.

    bookmarks: bookmark columns plus tag_names; tags: id, name, normalized_name.
    """
    if not curated_conflicts(archive, bookmarks, tags).isEmpty():
        raise CuratedConflict("curated rows collide with other rows; nothing was written")
    rows = with_defaults(
        bookmarks.withColumns(
            {
                "normalized_url": F.col("url"),
                "final_url": F.col("url"),
                "markdown_content": X.js_trim(F.col("markdown_content")),
                "plain_text": X.markdown_to_plain_fenced(X.js_trim(F.col("markdown_content"))),
                "content_length": X.content_length(X.js_trim(F.col("markdown_content"))),
                "is_content_edited": F.lit(False),
            }
        )
    )
    # A reset leaves a soft-delete mark alone, as the reset list does not contain it.
    marks = archive.bookmarks.select("id", F.col("deleted_at").alias("_deleted"))
    rows = with_defaults(rows.join(marks, "id", "left").withColumn("deleted_at", F.col("_deleted")))
    stored = archive.tags.select("normalized_name", F.col("id").alias("_id"), "created_at")
    plan = tags.select("id", "name", "normalized_name").join(stored, "normalized_name", "left")
    own = plan.where(F.col("_id").isNull() | (F.col("_id") == F.col("id")))
    tag_rows = own.select(
        "id",
        "name",
        "normalized_name",
        F.coalesce("created_at", now).alias("created_at"),
        now.alias("updated_at"),
    )
    names = plan.select("name", F.coalesce("_id", "id").alias("tag_id"))
    links = (
        bookmarks.select(F.col("id").alias("bookmark_id"), F.explode("tag_names").alias("name"))
        .join(names, "name")
        .select("bookmark_id", "tag_id", now.alias("created_at"))
    )
    result = Archive(
        _replace_rows(archive.bookmarks, rows),
        _replace_rows(archive.tags, tag_rows),
        cascade(archive.links, rows, "bookmark_id").unionByName(links),
    )
    actions = rows.select(F.lit("upserted").alias("action")).unionByName(
        plan.select(
            F.when(F.col("_id").isNull(), "created")
            .when(F.col("_id") != F.col("id"), "reused")
            .otherwise("updated")
            .alias("action")
        )
    )
    return Change(result, actions, _reject(rows.where(F.lit(False)), "id", "NOT_FOUND"))


def remove_curated(archive: Archive, bookmarks: DataFrame, tags: DataFrame) -> Change:
    """Remove a curated set; its tags stay where other bookmarks use them."""
    conflicts = curated_conflicts(archive, bookmarks, tags).where(
        F.col("conflict") != "URL_TAKEN"
    )
    if not conflicts.isEmpty():
        raise CuratedConflict("curated rows do not match the stored ones; nothing was removed")
    gone = archive.bookmarks.select("id").join(bookmarks.select("id"), "id", "left_semi")
    rest = remove_bookmarks(archive, gone)
    own = archive.tags.join(tags.select("id"), "id", "left_semi")
    used = rest.links.groupBy(F.col("tag_id").alias("id")).agg(F.count("*").alias("usage"))
    judged = own.join(used, "id", "left").withColumn("usage", F.coalesce("usage", F.lit(0)))
    free = judged.where(F.col("usage") == 0).select("id")
    result = rest.replace(tags=archive.tags.join(free, "id", "left_anti"))
    actions = gone.select(F.lit("deleted_bookmark").alias("action")).unionByName(
        judged.select(
            F.when(F.col("usage") == 0, "deleted_tag").otherwise("retained_tag").alias("action")
        )
    )
    return Change(result, actions, _reject(gone.where(F.lit(False)), "id", "NOT_FOUND"))


def change_summary(actions: DataFrame) -> DataFrame:
    """Rows per action."""
    return actions.groupBy("action").agg(F.count("*").alias("n"))


# --- audit --------------------------------------------------------------------------------------


def audit(archive: Archive) -> DataFrame:
    """Findings (rule, key, n) where the stored tables break their rules.

    Each table is read once: its rows become facts about a key (a bookmark's or a tag's id, a
    URL, a tag's name), all facts of a key are summed in one aggregate with partial sums, and
    the rules are tests of these sums. A key that any share of the rows has is no special case.
    """

    def fact(space: str, key: str, **counts: Column) -> Column:
        named = {name: counts.get(name, F.lit(0)).cast("long") for name in _COUNTS}
        return F.struct(
            F.lit(space).alias("space"),
            F.col(key).alias("key"),
            *(c.alias(name) for name, c in named.items()),
        )

    one = F.lit(1)
    missing = F.array_contains(F.array(*[F.col(c).isNull() for c in _REQUIRED]), True)
    odd = ~F.coalesce(F.col("extraction_status").isin(*K.EXTRACTION_STATUSES), F.lit(True))
    facts = (
        archive.bookmarks.select(
            F.inline(
                F.array(
                    fact("bookmark", "id", stored=one, missing=missing, odd=odd),
                    fact("url", "normalized_url", stored=one),
                )
            )
        )
        .unionByName(
            archive.tags.select(
                F.inline(
                    F.array(fact("tag", "id", stored=one), fact("name", "normalized_name", stored=one))
                )
            )
        )
        .unionByName(
            archive.links.select(
                F.inline(
                    F.array(fact("bookmark", "bookmark_id", linked=one), fact("tag", "tag_id", linked=one))
                )
            )
        )
    )
    sums = facts.groupBy("space", "key").agg(*(F.sum(name).alias(name) for name in _COUNTS))
    space, key = F.col("space"), F.col("key")
    stored, linked = F.col("stored"), F.col("linked")
    # Links without an id lead nowhere, whatever rows without an id there are.
    orphan = (linked > 0) & ((stored == 0) | key.isNull())
    rules = {
        "duplicate_id": ((space == "bookmark") & (stored > 1) & key.isNotNull(), stored),
        "duplicate_url": ((space == "url") & (stored > 1) & key.isNotNull(), stored),
        "duplicate_tag_name": ((space == "name") & (stored > 1) & key.isNotNull(), stored),
        "missing_value": ((space == "bookmark") & (F.col("missing") > 0), F.col("missing")),
        "unknown_status": ((space == "bookmark") & (F.col("odd") > 0), F.col("odd")),
        "orphan_bookmark_link": ((space == "bookmark") & orphan, linked),
        "orphan_tag_link": ((space == "tag") & orphan, linked),
        "too_many_tags": ((space == "bookmark") & (linked > K.MAX_TAGS_PER_BOOKMARK), linked),
    }
    found = F.array_compact(
        F.array(
            *(
                F.when(test, F.struct(F.lit(rule).alias("rule"), n.alias("n")))
                for rule, (test, n) in rules.items()
            )
        )
    )
    return sums.select("key", F.inline(found)).select("rule", "key", "n")


_COUNTS = ("stored", "missing", "odd", "linked")
_REQUIRED = ("url", "normalized_url", "final_url", "title", "domain", "created_at", "updated_at")

"""Predicates and derived fields of change and tag-change events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stream names, tags and account-name patterns of the public feed.
CHANGE_STREAM = "mediawiki.recentchange"
TAGS_STREAM = "mediawiki.revision-tags-change"
REVERT_TAGS = ("mw-reverted", "mw-rollback", "mw-undo", "mw-manual-revert")
REVERTED = "mw-reverted"
TEMPORARY_ACCOUNT = r"^~\d{4}-\d+(-\d+)?$"
IPV4 = r"^(\d{1,3}\.){3}\d{1,3}$"
IPV6 = r"^(?i)[0-9a-f:]+$"


def user_class(user: Column, bot: Column) -> Column:
    """bot / unknown / temporary / ip / registered; the bot flag outranks the name."""
    return (
        F.when(F.coalesce(bot, F.lit(False)), "bot")
        .when(user.isNull() | (user == ""), "unknown")
        .when(user.rlike(TEMPORARY_ACCOUNT), "temporary")
        .when(user.rlike(IPV4) | (user.contains(":") & user.rlike(IPV6)), "ip")
        .otherwise("registered")
    )


def is_classifiable(type_: Column, namespace: Column) -> Column:
    """Article edits and page creations."""
    return F.coalesce(type_.isin("edit", "new") & (namespace == 0), F.lit(False))


def is_page_deletion(type_: Column, log_type: Column, log_action: Column, title: Column) -> Column:
    return F.coalesce(
        (type_ == "log") & (log_type == "delete") & (log_action == "delete") & (title != ""), F.lit(False)
    )


def added_tags(tags: Column, prior: Column) -> Column:
    """Tags the event added. Order and duplicates stay (``array_except`` would drop both)."""
    before = F.coalesce(prior, F.array().cast("array<string>"))
    return F.filter(tags, lambda tag: ~F.array_contains(before, tag))


def revert_tags(tags: Column) -> Column:
    return F.filter(tags, lambda tag: tag.isin(*REVERT_TAGS))


def is_reverted(tags: Column) -> Column:
    return F.array_contains(tags, REVERTED)


def label_code(label: Column) -> Column:
    """1 / 0 / gone, for tables that keep undecidable rows out of rates."""
    return F.when(label == "reverted", "1").when(label == "not-reverted", "0").otherwise("gone")


def label_code_from_tags(found: Column, tags: Column) -> Column:
    """The same coding from a revision's present tags; a revision not found is gone."""
    return F.when(~found, "gone").when(is_reverted(tags), "1").otherwise("0")


def model_of(config: Column) -> Column:
    """The scorer behind a configuration name: what stands before ``__``."""
    return F.split(config, "__")[0]


def without_template(config: Column) -> Column:
    """A configuration name without its trailing ``__template`` part."""
    return F.regexp_replace(config, r"__[\w-]+$", "")

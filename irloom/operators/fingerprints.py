"""L6, I35: what a page reads from the model as one digest, folded upward along containment.

A symbol's own digest covers typed tokens: its content hash, its references with the hashes of
their targets, the functions that relate to it, its enumerators and, where wide, what the hash
leaves out. A subtree's digest covers its root's own one and its children's in order, so a change
reaches exactly the digests above it. A page's covers its seeds', its table of contents,
its file's path or its group. Lists of any length are hashed in runs, and the runs again, so none is
ever one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irloom.functions import scalar as s
from irloom.operators import tree
from irloom.operators.aggregate import numbered
from irloom.operators.plan import shown
from irloom.operators.query import empty
from irloom.operators.state import cut
from irloom.sources.schema import CONTAINER_KINDS, KIND

RUN = 1024


def list_digests(rows: DataFrame, key: str, order: list[str], token: str, to: str = "digest") -> DataFrame:
    """key and the digest of its tokens in order: runs of RUN tokens, runs of their digests, and so on up to one.

    A list is done when one run holds it, so its digest does not depend on how long others are.
    """
    at = numbered(rows.select(key, *order, F.col(token).alias("token")), [key], [*order, "token"], "__at")
    at = at.select(key, "token", F.col("__at").alias("position"))
    level, done = 0, None
    while True:
        run = F.floor(F.col("position") / RUN).cast("long")
        texts = F.transform(F.sort_array(F.collect_list(F.struct("position", "token"))), lambda x: x["token"])
        at = cut(at.groupBy(key, run.alias("position")).agg(F.sha2(F.concat(F.lit(f"{level}:"), F.array_join(texts, s.RECORD)), 256).alias("token")))
        over = at.where("position > 0").select(F.col(key).alias("__key")).distinct()
        ended = at.join(over, F.col(key) == F.col("__key"), "left_anti").select(key, F.col("token").alias(to))
        done = ended if done is None else done.unionByName(ended)
        if over.isEmpty():
            return done
        at, level = at.join(over, F.col(key) == F.col("__key"), "left_semi"), level + 1


def _joined(*columns: Column | str) -> Column:
    return F.concat_ws(s.RECORD, *(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns))


def own_digests(symbols: DataFrame, references: DataFrame | None = None, related: DataFrame | None = None, enumerators: DataFrame | None = None, template_parameters: DataFrame | None = None, wide: bool = False) -> DataFrame:
    """usr and own: the digest of a symbol's own tokens. `symbols` have content_hash; `related` has usr, other, key and rank."""
    hashes = symbols.select(F.col("usr").alias("h_usr"), F.col("content_hash").alias("h_hash"), F.col("qualified_name").alias("h_name"))
    out = symbols.select("usr", s.dep_token(F.lit("S"), "usr", "content_hash").alias("t_self"))

    def of(tokens: DataFrame, order: list[str], name: str) -> None:
        nonlocal out
        out = out.join(list_digests(tokens, "usr", order, "token", name).withColumnRenamed("usr", f"k_{name}"), F.col("usr") == F.col(f"k_{name}"), "left").drop(f"k_{name}")

    names = ["t_self"]
    if references is not None:
        told = references.join(hashes, F.col("to_usr") == F.col("h_usr"), "left").withColumn("usr", F.col("from_usr"))
        told = told.select("usr", "ref_kind", "ordinal", F.coalesce("to_usr", F.lit("")).alias("to_usr"), F.coalesce("to_spelling", F.lit("")).alias("to_spelling"), s.dep_token(F.lit("R"), "usr", "ref_kind", "ordinal", "to_usr", "to_spelling", "access", F.lit("T"), "h_hash").alias("token"))
        of(told, ["ref_kind", "ordinal", "to_usr", "to_spelling"], "t_references")
        names.append("t_references")
    if related is not None:
        told = related.join(hashes, F.col("other") == F.col("h_usr"))
        of(told.select("usr", "key", "rank", "other", s.dep_token(F.lit("L"), "usr", "other", "h_name", "h_hash").alias("token")), ["key", "rank", "other"], "t_related")
        names.append("t_related")
    if enumerators is not None:
        enums = symbols.where(F.col("kind") == KIND["enum"]).select(F.col("usr").alias("e_usr"))
        told = enumerators.join(enums, F.col("enum_usr") == F.col("e_usr"), "left_semi").join(hashes, F.col("usr") == F.col("h_usr"), "left")
        told = told.select(F.col("enum_usr"), "idx", F.col("usr").alias("n_usr"), s.dep_token(F.lit("N"), "usr", "name", "value", "value_is_signed", F.lit("E"), "h_hash").alias("token")).withColumnRenamed("enum_usr", "usr")
        of(told, ["idx", "n_usr"], "t_enumerators")
        names.append("t_enumerators")
    if wide:
        fields = [F.col(c) if c in symbols.columns else F.lit(None).cast("string") for c in ("spelling", "display_name", "parent_usr", "is_documented", "file_id", "line")]
        out = out.join(symbols.select(F.col("usr").alias("w_usr"), s.dep_token(F.lit("W"), "usr", *(f.cast("int") if n == 3 else f for n, f in enumerate(fields))).alias("t_wide")), F.col("usr") == F.col("w_usr")).drop("w_usr")
        names.append("t_wide")
        if template_parameters is not None:
            told = template_parameters.select(F.col("owner_usr").alias("usr"), "idx", s.dep_token(F.lit("WT"), "owner_usr", "idx", "param_kind", "name", "type_repr", "default_repr").alias("token"))
            of(told, ["idx"], "t_parameters")
            names.append("t_parameters")
    return out.select("usr", F.sha2(_joined(*names), 256).alias("own"))


def subtree_digests(symbols: DataFrame, own: DataFrame) -> DataFrame:
    """usr, own and subtree of every symbol: its own digest and its children's, below namespaces and records only."""
    rows = shown(symbols).join(own, "usr")
    opens = F.col("kind").isin(CONTAINER_KINDS)
    found = tree.levels(rows.select("usr", "parent_usr", "kind", "line", "qualified_name", "own"))
    out, below = [], None
    for level in reversed(found):
        if below is not None:
            lists = list_digests(below, "parent_usr", ["kind", "line", "qualified_name", "usr"], "subtree", "children").withColumnRenamed("parent_usr", "__up")
            level = level.join(lists, F.col("usr") == F.col("__up"), "left").drop("__up")
        else:
            level = level.withColumn("children", F.lit(None).cast("string"))
        children = F.when(opens, F.coalesce("children", F.lit(""))).otherwise(F.lit(""))
        below = cut(level.withColumn("subtree", F.sha2(_joined("own", children), 256)).drop("children"))
        out.append(below)
    return tree.together(out).select("usr", "own", "subtree") if out else own.select("usr", "own", F.col("own").alias("subtree"))


def page_fingerprints(pages: DataFrame, seeds: DataFrame, subtrees: DataFrame, contents: DataFrame | None = None, files: DataFrame | None = None, groups: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """page and fingerprint of every page of a plan.

    `subtrees` as from subtree_digests(); `contents` (page, position, stem) has the hubs' entries, `files` (page,
    path) the paths that headings show, `groups` and `members` (group_id, ordinal, usr, content_hash) those of group pages.
    """
    own = seeds.join(subtrees, "usr").select("page", "place", "usr", F.when(F.col("deep"), F.col("subtree")).otherwise(F.col("own")).alias("token"))
    parts = {"seeds": list_digests(own, "page", ["place", "usr"], "token")}
    if contents is not None:
        parts["toc"] = list_digests(contents.select("page", "position", s.dep_token(F.lit("TOC"), "stem").alias("token")), "page", ["position"], "token")
    if files is not None:
        parts["file"] = files.select("page", s.dep_token(F.lit("FILEPATH"), "path").alias("digest"))
    if groups is not None:
        key = lambda c: F.concat(F.lit("group:"), c)
        optional = [F.col(c) if c in groups.columns else F.lit("") for c in ("brief", "detail")]
        parts["group"] = groups.select(key(F.col("id")).alias("page"), s.dep_token(F.lit("G"), "id", "title", *optional).alias("digest"))
        subs = groups.where(~empty("parent_group_id")).select(key(F.col("parent_group_id")).alias("page"), "title", "id", key(F.col("id")).alias("own"))
        subs = subs.join(pages.select(F.col("page").alias("p_page"), "stem"), F.col("own") == F.col("p_page"))
        parts["subs"] = list_digests(subs.select("page", "title", "id", s.dep_token(F.lit("GS"), "id", "stem").alias("token")), "page", ["title", "id"], "token")
        if members is not None:
            told = members.select(key(F.col("group_id")).alias("page"), "ordinal", "usr", s.dep_token(F.lit("GM"), "usr", "content_hash").alias("token"))
            parts["members"] = list_digests(told, "page", ["ordinal", "usr"], "token")
    out = pages.select("page")
    for name, part in parts.items():
        out = out.join(part.select(F.col("page").alias("k_page"), F.col("digest").alias(f"d_{name}")), F.col("page") == F.col("k_page"), "left").drop("k_page")
    return out.select("page", F.sha2(_joined(*(f"d_{n}" for n in parts)), 256).alias("fingerprint"))


def stale_pages(now: DataFrame, before: DataFrame) -> DataFrame:
    """Pages whose fingerprint is another than before, or that were not there; and pages that are gone."""
    old = before.select(F.col("page").alias("o_page"), F.col("fingerprint").alias("o_fingerprint"))
    both = now.join(old, F.col("page") == F.col("o_page"), "full_outer")
    state = F.when(F.col("page").isNull(), "gone").when(F.col("o_page").isNull(), "new").when(F.col("fingerprint") != F.col("o_fingerprint"), "changed")
    return both.select(F.coalesce("page", "o_page").alias("page"), state.alias("state")).where("state IS NOT NULL")

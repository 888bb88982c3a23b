"""Stores of personal data detected by joining code facts to the rule tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datarights.functions import text as t
from datarights.operators.resolve import Code, head_of, join_name, lookup, resolve_constants, tail_of
from datarights.session import stage, stage_all
from datarights.sources.rules import Rules

STORE = ["repo_id", "kind", "id", "name", "model", "identity", "file", "line", "link_file", "link_line", "client", "flag", "ord"]
FIELD = ["repo_id", "kind", "id", "field", "file", "line", "declared", "flag"]


def null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def store_rows(df: DataFrame, kind, **cells) -> DataFrame:
    """Store rows with the columns not given left null."""
    cells = {"model": null(), "link_file": null(), "link_line": null("int"), "client": null(), "flag": null(), **cells, "kind": kind if isinstance(kind, Column) else F.lit(kind)}
    return df.select(*[(cells[c] if c in cells else F.col(c)).alias(c) for c in STORE])


def field_rows(df: DataFrame, kind, **cells) -> DataFrame:
    cells = {"declared": null(), "flag": null(), **cells, "kind": kind if isinstance(kind, Column) else F.lit(kind)}
    return df.select(*[(cells[c] if c in cells else F.col(c)).alias(c) for c in FIELD])


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def guard_of(name, r: Rules) -> Column:
    return t.guard_level(name, r.words("strong_fields"), r.words("qualified_fields"))


def importing(code: Code, words: list[str]) -> DataFrame:
    """Modules that import one of the named packages (or something inside one)."""
    hit = reduce(lambda a, b: a | b, [(F.col("dotted") == w) | F.col("dotted").startswith(w + ".") for w in words])
    return code.imports.where("scope IS NULL AND kind = 'external'").where(hit).select("repo_id", "module").distinct()


def first_module_file(code: Code) -> DataFrame:
    return code.modules.groupBy("repo_id", "module").agg(F.max("path").alias("module_file"))


def literals(calls: DataFrame, arg: Column, code: Code) -> DataFrame:
    """Adds `literal`, and where a constant was followed its const_file and const_line."""
    a = calls.withColumn("_a", arg)
    name = F.when(F.col("_a.kind").isin("name", "attribute"), F.col("_a.value"))
    asked = resolve_constants(a.select("repo_id", "module", name.alias("written")).where("written IS NOT NULL").distinct(), code)
    found = asked.select("repo_id", "module", F.col("written").alias("_w"), "const_value", "const_file", "const_line").where("const_value IS NOT NULL")
    out = a.withColumn("_w", name).join(found, ["repo_id", "module", "_w"], "left")
    text = (F.when(F.col("_a.kind") == "literal", F.col("_a.value")).when(F.col("_a.kind") == "fstring", F.col("_a.prefix")).otherwise(F.col("const_value")))
    return out.withColumn("literal", F.coalesce(text, F.lit(""))).drop("_a", "_w", "const_value")


def personal_arguments(calls: DataFrame, r: Rules, bare_names: bool = False) -> DataFrame:
    """repo_id, call_id, field: guarded names a call carries in its arguments."""
    args = F.concat("args", F.map_values("kw"))
    names = F.flatten(F.transform(args, lambda a: F.concat(
        a["names"], a["keys"], F.when((a["kind"] == "name") & F.lit(bare_names), F.array(a["value"])).otherwise(F.array().cast("array<string>")))))
    each = calls.select("repo_id", "call_id", F.explode(F.array_distinct(names)).alias("field"))
    return each.where(guard_of("field", r) != "")


# --- tables in code ---------------------------------------------------------------------------------------

def model_classes(code: Code, r: Rules) -> DataFrame:
    """repo_id, cls, django: classes that declare a table, with the table's name."""
    b = code.bases
    tail = tail_of("written")
    subject = tail.isin(r.words("subject_bases"))
    direct = b.where(F.col("written").isin(r.words("model_bases")) | ((tail == "Model") & F.col("written").contains("models")) | subject
                     | F.col("dotted").isin(r.words("model_bases")) | F.col("dotted").endswith("db.models.Model"))
    direct = direct.select("repo_id", F.col("cls").alias("ancestor")).distinct()
    django = code.mro.where("imported").join(direct, ["repo_id", "ancestor"]).select("repo_id", "cls", F.lit(True).alias("django")).distinct()
    ca = code.class_assigns
    tablename = ca.where("target = '__tablename__'").groupBy("repo_id", F.col("owner").alias("cls")).agg(
        F.lit(True).alias("_named"), F.min_by("value", F.when(F.col("value_kind") == "literal", F.col("seq"))).alias("_table"))
    meta = ca.where("target = 'db_table' AND value_kind = 'literal' AND owner LIKE '%.Meta'").groupBy(
        "repo_id", F.regexp_replace("owner", r"\.Meta$", "").alias("cls")).agg(F.min_by("value", "seq").alias("_meta"))
    factories = code.assigns.where("scope IS NULL AND value_kind = 'call'").where(tail_of("value").isin(r.words("declarative_factories"))).select(
        "repo_id", join_name(F.col("module"), F.col("target")).alias("dotted"), F.lit(True).alias("_made")).distinct()
    names = r.words("declarative_bases")
    decl = b.join(factories, ["repo_id", "dotted"], "left").where(F.col("_made") | F.col("written").isin(names) | tail.isin(names))
    decl = decl.select("repo_id", "cls", F.lit(True).alias("_decl")).distinct()
    columns = code.fields.where("parent IS NULL").where(tail_of("call").isin(r.words("column_calls"))).select(
        "repo_id", F.col("owner").alias("cls"), F.lit(True).alias("_columns")).distinct()
    sqlmodel = b.where(tail == "SQLModel").select("repo_id", "cls", F.lit(True).alias("_sqlmodel")).distinct()
    subj = b.where(subject).select("repo_id", "cls", F.lit(True).alias("subject_base")).distinct()
    out = code.classes.select("repo_id", F.col("name").alias("cls"), "short", "module", "file", "line", "raw_kw", "decorators")
    for part in (django, tablename, meta, decl, columns, sqlmodel, subj):
        out = out.join(part, ["repo_id", "cls"], "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    kw_table = F.coalesce(t.norm(F.try_element_at("raw_kw", F.lit("table"))) == "true", F.lit(False))
    declarative = flag("_named") | kw_table | flag("_decl")
    declares = flag("_named") | kw_table | (~flag("_sqlmodel") & flag("_columns"))
    kept = out.withColumn("django", flag("django")).where(F.col("django") | (declarative & declares))
    table = F.coalesce("_meta", F.when(F.col("_table").isNotNull(), F.col("_table")), t.norm("short"))
    return kept.select("repo_id", "cls", "short", "module", "file", "line", "decorators", "django", flag("subject_base").alias("subject_base"), table.alias("table"))


def relational(code: Code, models: DataFrame, r: Rules) -> tuple[DataFrame, DataFrame]:
    """Row stores and file stores of models, core tables, and all their fields."""
    decls = code.fields.where("parent IS NULL").select("repo_id", F.col("owner").alias("ancestor"), "target", "call", "line", "path", "seq", "kw")
    inherited = code.mro.where("named").select("repo_id", "cls", "ancestor", F.col("named_path").alias("rank"))
    every = models.select("repo_id", "cls", "short", "table").join(inherited, ["repo_id", "cls"]).join(decls, ["repo_id", "ancestor"])
    kept = every.groupBy("repo_id", "cls", "target").agg(F.min_by(F.struct("short", "table", "call", "line", "path", "kw"), F.struct("rank", "seq")).alias("d"))
    kept = kept.select("repo_id", "cls", F.col("target").alias("field"), "d.*").withColumn("fn", tail_of("call"))
    row_key = F.concat(F.lit("1|"), "cls")
    rows = store_rows(models, "relational", id=F.col("table"), name=F.col("table"), model=F.col("cls"), identity=F.col("table"), ord=row_key)
    is_file = F.col("fn").isin(r.words("file_field_calls"))
    is_column = (F.col("fn").endswith("Field") | F.col("fn").isin(r.words("column_calls"))) & ~F.col("fn").isin(r.words("relation_calls")) & (F.col("fn") != "relationship")
    opaque = F.when(F.col("fn").isin(r.words("opaque_calls")), "opaque_container")
    columns = field_rows(kept.where(is_column & ~is_file), "relational", id=F.col("table"), file=F.col("path"), declared=F.col("fn"), flag=opaque)
    files = kept.where(is_file).withColumn("id", F.concat(t.norm("short"), F.lit("."), "field"))
    upload = F.col("kw")["upload_to"]["value"]
    file_stores = store_rows(files, "object_storage", name=F.col("id"), model=F.col("cls"), identity=F.coalesce(F.nullif(upload, F.lit("")), "id"),
                             file=F.col("path"), link_file=F.col("path"), link_line=F.col("line"), flag=F.lit("django_file_field"), ord=row_key)
    file_fields = field_rows(files, "object_storage", file=F.col("path"), declared=F.col("fn"))
    core = core_tables(code)
    core_stores = store_rows(core, "relational", id=F.col("table"), name=F.col("table"), identity=F.col("table"), file=F.col("path"), ord=F.concat(F.lit("0|"), "module"))
    core_fields = field_rows(core.select("*", F.explode(F.slice("keys", F.lit(2), F.greatest(F.size("keys") - 1, F.lit(0)))).alias("field")),
                             "relational", id=F.col("table"), file=F.col("path"), declared=F.lit("Column"))
    return union([core_stores, rows, file_stores]), union([columns, file_fields, core_fields])


def core_tables(code: Code) -> DataFrame:
    """Tables built by a `Table("name", ...)` call: the first string names the store."""
    made = code.assigns.where("scope IS NULL AND value_kind = 'call' AND size(keys) > 0").where(tail_of("value") == "Table")
    return made.select("repo_id", "module", "path", "line", "target", "keys", F.element_at("keys", 1).alias("table"))


def relations(code: Code, models: DataFrame, core: DataFrame, r: Rules) -> DataFrame:
    """Foreign keys, relationships and association tables, each with its target store.

    A written class is the imported one, else one of the same module, else the first class of
    that name; a table name matches a store's id exactly, then normalised.
    """
    d = code.fields.where("parent IS NULL").join(models.select("repo_id", F.col("cls").alias("owner"), "module", F.col("table").alias("own")), ["repo_id", "owner"])
    d = d.withColumn("fn", tail_of("call"))
    first_arg, kw = F.get("args", F.lit(0)), F.col("kw")
    fk = d.where(F.col("fn").isin(r.words("relation_calls")) & (F.size("raw") > 0)).select(
        "*", F.coalesce(F.nullif(F.get("raw", F.lit(0)), F.lit("")), F.col("raw_kw")["to"]).alias("written"), F.lit("fk").alias("kind"),
        tail_of(F.coalesce(kw["on_delete"]["value"], F.lit(""))).alias("token"), F.coalesce(kw["related_name"]["value"], F.lit("")).alias("related_name"))
    rel = d.where("fn = 'relationship'")
    plain = rel.select("*", F.coalesce(F.when(F.size("args") > 0, first_arg["value"]), F.col("raw_kw")["argument"]).alias("written"), F.lit("relationship").alias("kind"),
                       F.coalesce(kw["cascade"]["value"], F.lit("")).alias("token"), F.lit("").alias("related_name"))
    second = rel.where(F.coalesce(F.col("raw_kw")["secondary"], F.lit("")) != "").select(
        "*", F.col("raw_kw")["secondary"].alias("written"), F.lit("secondary").alias("kind"), F.col("raw_kw")["secondary"].alias("token"), F.lit("").alias("related_name"))
    classed = union([fk, plain, second]).withColumn("short", tail_of(F.regexp_replace(F.coalesce("written", F.lit("")), "^['\"]+|['\"]+$", ""))).where("short <> ''")
    classed = lookup(classed.withColumn("head", F.col("short")).withColumn("scope", null()), code.imports)
    classed = classed.withColumn("_d", F.coalesce("bind_dotted", "short")).withColumn("_l", join_name(F.col("module"), F.col("short")))
    by_name = models.select("repo_id", F.col("cls").alias("_d"), F.col("table").alias("_td"))
    by_local = models.select("repo_id", F.col("cls").alias("_l"), F.col("table").alias("_tl"))
    by_short = models.groupBy("repo_id", "short").agg(F.min_by("table", "cls").alias("_ts"))
    by_var = core.groupBy("repo_id", F.col("target").alias("short")).agg(F.max_by("table", "module").alias("_tv"))
    for part, on in ((by_name, "_d"), (by_local, "_l"), (by_short, "short"), (by_var, "short")):
        classed = classed.join(part, ["repo_id", on], "left")
    target = F.coalesce("_td", "_tl", "_ts", F.when(F.col("kind") == "secondary", F.coalesce("_tv", "short")))
    passive = F.coalesce(t.norm(F.col("kw")["passive_deletes"]["value"]) == "true", F.lit(False))
    is_fk = F.col("kind") == "fk"
    out = classed.where(target.isNotNull()).select(
        "repo_id", F.when(is_fk, target).otherwise(F.col("own")).alias("parent"), F.when(is_fk, F.col("own")).otherwise(target).alias("child"), "kind", "token",
        F.lit("").alias("ondelete"), (passive & (F.col("kind") == "relationship")).alias("passive_deletes"), F.col("path").alias("file"), "line",
        F.col("target").alias("field_name"), "related_name")
    nested = code.fields.where("parent IS NOT NULL").where(tail_of("call") == "ForeignKey").where(F.size("args") > 0).groupBy("repo_id", "path", "parent").agg(
        F.min_by(F.struct(F.get("args", F.lit(0))["value"].alias("ref"), F.col("kw")["ondelete"]["value"].alias("ondelete")), "seq").alias("n"))
    others = d.where(~F.col("fn").isin(r.words("relation_calls")) & (F.col("fn") != "relationship")).withColumn("_seq", F.col("seq"))
    ddl = others.join(nested.withColumnRenamed("parent", "_seq"), ["repo_id", "path", "_seq"]).withColumn("table", head_of("n.ref"))
    named = union([models.select("repo_id", "table"), core.select("repo_id", "table")]).distinct()
    exact = named.select("repo_id", "table", F.lit(True).alias("_same"))
    alike = named.groupBy("repo_id", t.norm("table").alias("_n")).agg(F.min("table").alias("_alike"))
    ddl = ddl.join(exact, ["repo_id", "table"], "left").withColumn("_n", t.norm("table")).join(alike, ["repo_id", "_n"], "left")
    parent = F.when(F.col("_same"), F.col("table")).otherwise(F.coalesce("_alike", "table"))
    ddl = ddl.select("repo_id", parent.alias("parent"), F.col("own").alias("child"), F.lit("fk").alias("kind"), F.lit("").alias("token"),
                     F.coalesce("n.ondelete", F.lit("")).alias("ondelete"), F.lit(False).alias("passive_deletes"), F.col("path").alias("file"), "line",
                     F.col("target").alias("field_name"), F.lit("").alias("related_name"))
    return out.unionByName(ddl)


# --- stores that are not tables -----------------------------------------------------------------------------

def _line_targets(code: Code) -> DataFrame:
    """The module-level name a call on some line is bound to."""
    return (code.assigns.where("scope IS NULL AND NOT contains(target, '.')").groupBy("repo_id", "module", "line")
            .agg(F.min_by("target", "seq").alias("bound")))


def buckets(code: Code, r: Rules) -> tuple[DataFrame, DataFrame]:
    """Object storage by bucket literal, in modules that hold a storage handle."""
    c = code.calls
    client = F.col("dotted").isin(r.words("bucket_clients")) & (F.get("args", F.lit(0))["value"] == "s3")
    handles = c.where(client | tail_of("dotted").isin(r.words("bucket_backends")))
    handles = handles.join(_line_targets(code), ["repo_id", "module", "line"], "left").withColumn("_var", F.coalesce("bound", F.when(client, "s3").otherwise("storage")))
    per_module = handles.groupBy("repo_id", "module").agg(F.min_by("line", "call_id").alias("_line"), F.collect_set("_var").alias("_vars"))
    used = literals(c.where(F.map_contains_key("kw", F.lit("Bucket"))).join(per_module, ["repo_id", "module"]), F.col("kw")["Bucket"], code).where("literal <> ''")
    keys = key_builders(code, r)
    first_key = keys.groupBy("repo_id", "module").agg(F.min(F.struct("line", "file")).alias("_key"))
    used = used.join(first_key, ["repo_id", "module"], "left")
    base = used.select("repo_id", "module", F.col("literal").alias("id"), F.col("literal").alias("name"), F.col("literal").alias("identity"),
                       F.coalesce("const_file", "path").alias("file"), F.coalesce("const_line", "_line").alias("line"), F.col("_key.file").alias("link_file"),
                       F.col("_key.line").alias("link_line"), F.explode("_vars").alias("client"), F.concat(F.lit("2|"), "module", F.lit("|"), "call_id").alias("ord"))
    stores = store_rows(base, "object_storage", link_file=F.col("link_file"), link_line=F.col("link_line"), client=F.col("client"))
    fields = used.select("repo_id", "module", F.col("literal").alias("id")).distinct().join(keys, ["repo_id", "module"])
    return stores, field_rows(fields, "object_storage", field=F.col("symbol"), declared=F.lit("key"))


def key_builders(code: Code, r: Rules) -> DataFrame:
    """Module-level functions that build a storage key for a subject."""
    s = code.symbols.where("owner IS NULL")
    about = F.exists("args", lambda a: t.subject_word(a, r.words("subject_words")))
    return s.where(F.col("short").endswith("_key") | (F.col("short").contains("key") & about)).select(
        "repo_id", "module", F.col("short").alias("symbol"), "file", "line")


def caches(code: Code, r: Rules) -> tuple[DataFrame, DataFrame]:
    """Cache namespaces by the literal prefix of the key written."""
    c = code.calls
    made = c.where(tail_of("dotted").isin(r.words("cache_clients"))).join(importing(code, r.words("cache_imports")), ["repo_id", "module"], "left_semi")
    made = made.where((F.col("bind_kind") == "external")).join(_line_targets(code), ["repo_id", "module", "line"], "left")
    handles = made.select("repo_id", "module", F.coalesce("bound", tail_of("dotted")).alias("_head"), F.lit(True).alias("_handle")).distinct()
    writes = c.where(F.col("name").isin(r.words("cache_writes")) & (F.size("args") > 0)).withColumn("_head", head_of("receiver"))
    writes = writes.join(handles, ["repo_id", "module", "_head"], "left").where("_handle OR _head = 'cache'")
    used = literals(writes, F.get("args", F.lit(0)), code).withColumn("id", t.namespace("literal")).where("id <> ''")
    stores = store_rows(used, "cache", name=F.col("id"), identity=F.col("id"), file=F.col("path"), link_file=F.col("path"), link_line=F.col("line"),
                        client=F.col("_head"), ord=F.concat(F.lit("3|"), "module", F.lit("|"), "call_id"))
    personal = used.select("repo_id", "call_id", "id", "path", "line").join(personal_arguments(used, r), ["repo_id", "call_id"])
    return stores, field_rows(personal, "cache", file=F.col("path"))


def indexes(code: Code, r: Rules) -> tuple[DataFrame, DataFrame]:
    """Search indexes by the literal of the index argument."""
    writes = code.calls.where(F.col("name").isin(r.words("index_writes")) & F.map_contains_key("kw", F.lit("index")))
    writes = writes.join(importing(code, r.words("index_imports")), ["repo_id", "module"], "left_semi")
    used = literals(writes, F.col("kw")["index"], code).withColumn("id", F.col("literal")).where("id <> ''")
    stores = store_rows(used, "search_index", name=F.col("id"), identity=F.col("id"), file=F.coalesce("const_file", "path"), line=F.coalesce("const_line", "line"),
                        link_file=F.col("path"), link_line=F.col("line"), client=head_of("receiver"), ord=F.concat(F.lit("4|"), "module", F.lit("|"), "call_id"))
    personal = used.select("repo_id", "call_id", "id", "path", "line").join(personal_arguments(used, r), ["repo_id", "call_id"])
    return stores, field_rows(personal, "search_index", file=F.col("path"))


def first_literal(calls: DataFrame, names: list[str], code: Code) -> DataFrame:
    """Adds `literal`: of the first keyword in `names` that has one, else the empty string."""
    each = calls.select("repo_id", "module", "call_id", "kw", F.explode(F.array(*[F.struct(F.lit(i).alias("o"), F.lit(n).alias("n")) for i, n in enumerate(names)])).alias("k"))
    each = literals(each.where(F.map_contains_key("kw", F.col("k.n"))), F.col("kw")[F.col("k.n")], code).where("literal <> ''")
    best = each.groupBy("repo_id", "call_id").agg(F.min_by("literal", "k.o").alias("literal"))
    return calls.join(best, ["repo_id", "call_id"], "left").withColumn("literal", F.coalesce("literal", F.lit("")))


def queues(code: Code, r: Rules) -> tuple[DataFrame, DataFrame]:
    """Queues, only where the payload carries personal names."""
    sent = code.calls.where(F.col("name").isin(r.words("queue_calls"))).join(importing(code, r.words("queue_imports")), ["repo_id", "module"], "left_semi")
    personal = personal_arguments(sent, r)
    sent = sent.join(personal.select("repo_id", "call_id").distinct(), ["repo_id", "call_id"], "left_semi")
    used = first_literal(sent, r.words("queue_name_kwargs"), code)
    used = used.withColumn("id", F.coalesce(F.nullif("literal", F.lit("")), F.nullif(head_of("receiver"), F.lit("")), "name"))
    stores = store_rows(used, "queue", name=F.col("id"), identity=F.col("id"), file=F.col("path"), link_file=F.col("path"), link_line=F.col("line"),
                        ord=F.concat(F.lit("5|"), "module", F.lit("|"), "call_id"))
    fields = used.select("repo_id", "call_id", "id", "path", "line").join(personal, ["repo_id", "call_id"])
    return stores, field_rows(fields, "queue", file=F.col("path"))


def matches_suffix(column: str, calls: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [(F.col(column) == c) | F.col(column).endswith("." + c) | (F.col("name") == c) for c in calls]) if calls else F.lit(False)


def recipients(code: Code, r: Rules) -> tuple[DataFrame, DataFrame]:
    """Third parties: imported (or named in the source) and sent personal names, or sent the
    fields an SDK transmits by default."""
    defaults = r.rows("default_fields")
    switches = r.map("pii_switches")
    stores, fields = [], []
    for name, _rule, imports, texts, sends, _deletes, _forward in r.rows("recipients"):
        sent = code.calls.where(matches_suffix("dotted", sends))
        if imports:
            sent = sent.join(importing(code, imports), ["repo_id", "module"], "left_semi")
        if texts:
            has = code.files.where(t.contains_any(F.col("text"), texts)).select("repo_id", "path")
            sent = sent.join(has, ["repo_id", "path"], "left_semi")
        personal = personal_arguments(sent, r)
        shipped = [d for d in defaults if d[0] == name]
        if not shipped:
            sent = sent.join(personal.select("repo_id", "call_id").distinct(), ["repo_id", "call_id"], "left_semi")
        at = sent.select("repo_id", "module", "call_id", "path", "line", F.lit(name).alias("id"))
        stores.append(store_rows(at, "third_party", name=F.col("id"), identity=F.col("id"), file=F.col("path"), link_file=F.col("path"), link_line=F.col("line"),
                                 flag=F.lit(f"recipient:{name}"), ord=F.concat(F.lit("6|"), "id", F.lit("|"), "module", F.lit("|"), "call_id")))
        fields.append(field_rows(at.join(personal, ["repo_id", "call_id"]), "third_party", file=F.col("path")))
        if shipped:
            on = code.calls.where((t.norm(F.col("kw")[switches["flag_kwarg"]]["value"]) == "true") | F.map_contains_key("kw", F.lit(switches["supersedes_kwarg"]))
                                  | F.col("name").isin(r.words("pii_calls"))).select("repo_id", "module", F.lit(True).alias("_pii")).distinct()
            each = at.join(on, ["repo_id", "module"], "left").select("*", F.explode(F.array(*[
                F.struct(F.lit(f).alias("f"), F.lit(bool(pii)).alias("p")) for _n, f, _c, pii in shipped])).alias("d"))
            each = each.where("NOT d.p OR _pii")
            fields.append(field_rows(each, "third_party", field=F.col("d.f"), file=F.col("path"), declared=F.when(F.col("d.p"), "sdk_pii").otherwise("sdk_default")))
    return union(stores), union(fields)


def logs(code: Code, r: Rules) -> tuple[DataFrame, DataFrame]:
    """Log sinks that receive personal values."""
    mods = importing(code, r.words("log_imports"))
    c = code.calls.join(mods, ["repo_id", "module"], "left_semi")
    made = literals(c.where(F.col("name").isin(r.words("log_factories")) & (F.size("args") > 0)), F.get("args", F.lit(0)), code)
    named = made.groupBy("repo_id", "module").agg(F.min_by(F.struct(F.coalesce(F.nullif("literal", F.lit("")), "module").alias("n"), "line"), "line").alias("_log"))
    said = c.where(F.col("name").isin(r.words("log_calls")))
    personal = personal_arguments(said, r, bare_names=True)
    used = said.join(personal.select("repo_id", "call_id").distinct(), ["repo_id", "call_id"], "left_semi").join(named, ["repo_id", "module"], "left")
    used = used.withColumn("id", F.coalesce(F.nullif("_log.n", F.lit("")), F.nullif("module", F.lit("")), F.lit("stdout")))
    stores = store_rows(used, "log", name=F.col("id"), identity=F.col("id"), file=F.col("path"), line=F.coalesce("_log.line", "line"), link_file=F.col("path"),
                        link_line=F.col("line"), ord=F.concat(F.lit("7|"), "module", F.lit("|"), "call_id"))
    fields = used.select("repo_id", "call_id", "id", "path", "line").join(personal, ["repo_id", "call_id"])
    return stores, field_rows(fields, "log", file=F.col("path"))


def backups(code: Code, r: Rules) -> tuple[DataFrame, DataFrame]:
    """Backups by name or snapshot call; name and columns from module constants."""
    words = r.words("backup_words")
    mods = first_module_file(code).withColumn("base", tail_of("module"))
    by_name = mods.where(t.contains_any(t.norm("base"), words)).select("repo_id", "module")
    by_symbol = code.symbols.where(t.contains_any(t.norm("short"), words)).select("repo_id", "module")
    snaps = code.calls.where(F.col("name").isin(r.words("backup_calls"))).select("repo_id", "module").distinct()
    hit = union([by_name, by_symbol, snaps]).distinct()

    def constant(names: list[str], alias: str) -> DataFrame:
        asked = hit.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("o"), F.lit(n).alias("n")) for i, n in enumerate(names)])).alias("k"))
        found = resolve_constants(asked.withColumn("written", F.col("k.n")), code).where("const_value IS NOT NULL")
        return found.groupBy("repo_id", "module").agg(F.min_by(F.struct("const_value", "const_file", "const_line"), "k.o").alias(alias))
    used = (hit.join(mods, ["repo_id", "module"]).join(constant(r.words("backup_name_constants"), "_n"), ["repo_id", "module"], "left")
            .join(constant(r.words("backup_column_constants"), "_c"), ["repo_id", "module"], "left")
            .join(snaps.withColumn("_snap", F.lit(True)), ["repo_id", "module"], "left"))
    used = used.withColumn("id", F.coalesce("_n.const_value", "base"))
    stores = store_rows(used, "backup", name=F.col("id"), identity=F.col("id"), file=F.coalesce("_n.const_file", "module_file"), line=F.coalesce("_n.const_line", F.lit(1)),
                        link_file=F.col("_c.const_file"), link_line=F.col("_c.const_line"), flag=F.when(F.col("_snap") & F.col("_c").isNull(), "opaque_dump"),
                        ord=F.concat(F.lit("8|"), "module"))
    fields = used.where("_c IS NOT NULL").select("repo_id", "id", F.col("_c.const_file").alias("file"), F.col("_c.const_line").alias("line"),
                                                 F.explode(F.split("_c.const_value", r"\|")).alias("field"))
    return stores, field_rows(fields, "backup")


# --- one table of stores ------------------------------------------------------------------------------------

def merge_stores(parts: DataFrame) -> DataFrame:
    """One row per (kind, id). An id shared by two kinds is kept apart and flagged on both."""
    first = F.min_by(F.struct("name", "model", "identity", "file", "line", "link_file", "link_line"), F.struct("ord", "line")).alias("s")
    merged = parts.groupBy("repo_id", "kind", "id").agg(first, F.array_sort(F.collect_set("client")).alias("clients"), F.array_sort(F.collect_set("flag")).alias("flags"), F.min("ord").alias("ord"))
    kinds = merged.groupBy("repo_id", "id").agg(F.min_by("kind", "ord").alias("_first"), F.count("*").alias("_kinds"))
    out = merged.join(kinds, ["repo_id", "id"])
    conflict = F.when(F.col("_kinds") > 1, F.array(F.lit("store_id_conflict"))).otherwise(F.array().cast("array<string>"))
    final = F.when(F.col("kind") == F.col("_first"), F.col("id")).otherwise(F.concat("id", F.lit("#"), "kind"))
    return out.select("repo_id", "kind", final.alias("store_id"), F.col("id").alias("raw_id"), "s.*", "clients", F.concat("flags", conflict).alias("flags"))


def subject_links(stores: DataFrame, relations_: DataFrame) -> DataFrame:
    """Adds `linked`, and the citation: a root links itself, then fk, association, relationship to a root."""
    roots = stores.where("subject_root").select("repo_id", F.col("store_id").alias("_root"))
    rank = F.when(F.col("kind") == "fk", 0).when(F.col("kind") == "secondary", 1).otherwise(2)
    ways = relations_.select("repo_id", "parent", "child", "file", "line", rank.alias("_rank"))
    down = ways.join(roots, [ways["repo_id"] == roots["repo_id"], ways["parent"] == roots["_root"]], "left_semi").select("repo_id", F.col("child").alias("store_id"), "_rank", "file", "line")
    up = ways.join(roots, [ways["repo_id"] == roots["repo_id"], ways["child"] == roots["_root"]], "left_semi").select("repo_id", F.col("parent").alias("store_id"), "_rank", "file", "line")
    best = down.unionByName(up).groupBy("repo_id", "store_id").agg(F.min(F.struct("_rank", "file", "line")).alias("_link"))
    out = stores.join(best, ["repo_id", "store_id"], "left")
    by_relation = (F.col("kind") == "relational") & F.col("_link").isNotNull()
    if "link_file" not in stores.columns:
        return out.withColumn("linked", F.col("subject_root") | by_relation).drop("_link")
    file = F.coalesce("link_file", F.when(F.col("subject_root"), F.col("file")), F.when(by_relation, F.col("_link.file")))
    line = F.coalesce("link_line", F.when(F.col("subject_root"), F.col("line")), F.when(by_relation, F.col("_link.line")))
    return out.withColumn("link_file", file).withColumn("link_line", line).withColumn("linked", F.col("link_file").isNotNull()).drop("_link")


def store_guard(stores: DataFrame, fields: DataFrame, subject_words: list[str]) -> DataFrame:
    """Adds `guard`: strong where a field is, qualified where a field is and the store has a subject."""
    levels = fields.groupBy("repo_id", "store_id").agg(F.bool_or(F.col("guard") == "strong").alias("_s"), F.bool_or(F.col("guard") == "qualified").alias("_q"))
    out = stores.join(levels, ["repo_id", "store_id"], "left")
    named = t.subject_word("name" if "name" in stores.columns else "store_id", subject_words)
    guard = F.when(F.col("_s"), "strong").when(F.col("_q") & (F.col("linked") | named), "qualified").otherwise("")
    return out.withColumn("guard", guard).drop("_s", "_q")


def one_or_disagree(settings: DataFrame, keys: list[str], value: str = "mode") -> DataFrame:
    """The value all settings agree on, else DISAGREE; never their union."""
    return settings.groupBy(*keys).agg(F.when(F.min(value) == F.max(value), F.min(value)).otherwise("DISAGREE").alias(value))


def settings_facts(code: Code, r: Rules) -> dict[str, DataFrame]:
    """Installed apps, the user model, engines and schedule registrations, read off assignments and calls."""
    a = code.assigns.where("scope IS NULL")
    apps = a.where("target = 'INSTALLED_APPS'").select("repo_id", "module", F.col("path").alias("file"), "line", "keys", "seq")
    last = apps.groupBy("repo_id", "module").agg(F.max_by(F.struct("file", "line", "keys"), "seq").alias("x")).select("repo_id", "module", "x.*")
    mode = (F.when(F.arrays_overlap("keys", F.array(*[F.lit(w) for w in r.words("cleanup_select")])), "SELECT")
            .when(F.arrays_overlap("keys", F.array(*[F.lit(w) for w in r.words("cleanup_all")])), "ALL").otherwise("OFF"))
    cleanup = one_or_disagree(last.withColumn("mode", mode), ["repo_id"])
    user = a.where("target = 'AUTH_USER_MODEL' AND value_kind = 'literal'").groupBy("repo_id").agg(F.max_by("value", F.struct("module", "seq")).alias("user_model"))
    databases = a.where("target = 'DATABASES'").select("repo_id", F.col("path").alias("file"), "line", F.explode("keys").alias("url"), F.lit("DATABASES").alias("var")).where("url LIKE 'django.db.backends.%'")
    made = code.calls.where("name = 'create_engine'")
    made = literals(made, F.get("args", F.lit(0)), code).join(_line_targets(code), ["repo_id", "module", "line"], "left")
    engines = databases.unionByName(made.select("repo_id", F.col("path").alias("file"), "line", F.col("literal").alias("url"), F.coalesce(tail_of("bound"), F.lit("")).alias("var")))
    in_settings = a.where(F.col("target").isin(r.words("schedule_settings"))).select("repo_id", F.col("path").alias("file"), "line", F.col("keys").alias("names"), F.col("target").alias("how"))
    cron = a.where((F.col("value_kind") == "literal") & t.is_cron("value")).select("repo_id", F.col("path").alias("file"), "line", F.array("module").alias("names"), F.lit("cron_literal").alias("how"))
    called = code.calls.where(F.col("name").isin(r.words("schedule_calls"))).select("repo_id", F.col("path").alias("file"), "line", F.array().cast("array<string>").alias("names"), F.col("name").alias("how"))
    return {"apps": last, "cleanup": cleanup, "user_model": user, "engines": engines, "schedules": union([in_settings, cron, called])}


def detect_stores(code: Code, r: Rules, detectors: list | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """stores, store_fields, relations of every repository.

    `detectors`: further functions Code -> (store rows, field rows), merged after the built-in ones.
    """
    models = code.extra["models"] = stage(model_classes(code, r))
    core = core_tables(code)
    parts = [relational(code, models, r)] + [d(code, r) for d in (buckets, caches, indexes, queues, recipients, logs, backups)]
    parts += [d(code) for d in detectors or []]
    # Every detector is a job of its own: written once, small plans, no shared recomputation.
    flat = stage_all([df for pair in parts for df in pair])
    parts = list(zip(flat[::2], flat[1::2]))
    merged = stage(merge_stores(union([s for s, _ in parts])))
    ids = merged.select("repo_id", "kind", F.col("raw_id").alias("id"), "store_id")
    fields = union([f for _, f in parts]).join(ids, ["repo_id", "kind", "id"])
    fields = fields.groupBy("repo_id", "store_id", "kind", "field").agg(F.min(F.struct("line", "file", "declared", "flag")).alias("f")).select("repo_id", "store_id", "kind", "field", "f.*")
    fields, rel = stage_all([fields.withColumn("guard", guard_of("field", r)), relations(code, models, core, r)])
    auth = settings_facts(code, r)["user_model"]
    strong = fields.where("guard = 'strong'").select("repo_id", "store_id", F.lit(True).alias("_strong")).distinct()
    about = models.select("repo_id", F.col("cls").alias("model"), "short", "subject_base")
    s = merged.join(about, ["repo_id", "model"], "left").join(auth, ["repo_id"], "left").join(strong, ["repo_id", "store_id"], "left")
    names = r.words("subject_root_names")
    root = (F.col("kind") == "relational") & F.col("short").isNotNull() & (
        F.coalesce("subject_base", F.lit(False)) | F.coalesce(t.norm(tail_of("user_model")) == t.norm("short"), F.lit(False))
        | ((t.in_words(F.col("short"), names) | t.in_words(F.col("name"), names)) & F.coalesce("_strong", F.lit(False))))
    s = s.withColumn("subject_root", F.coalesce(root, F.lit(False))).drop("short", "subject_base", "user_model", "_strong")
    stores = store_guard(subject_links(s, rel), fields, r.words("subject_words")).withColumn("node", F.concat(F.lit("store:"), "store_id"))
    return stage(stores), fields, rel

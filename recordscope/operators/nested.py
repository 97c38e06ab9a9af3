"""Problem 6: deeply nested JSON records as related flat tables.

A depth-first traversal gives every node of a record a pre-order and a post-order number. Each record comes out as rows: the
root, every list item that is an object, and the scalars and lists inside lists; a row holds its own members, those of plain inner
objects with dotted names. One node lies inside another exactly if its interval does, and that links each row with the
nearest item around it. The rows hold all of the record: nulls, empty lists and numbers as they are written.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE_SCHEMA = "doc_no bigint, list_path string, kind string, child_path string, level int, pre bigint, post bigint, fields map<string,string>"
#: Kinds of rows: the root; objects in lists, and objects alone where the schema has a list; scalars and lists inside lists.
ROOT, ITEM, LONE, VALUE, LIST = "root", "item", "lone", "value", "list"
#: schema_catalog is a table of schemas, not of data; more rows than this are refused.
MAX_SCHEMAS = 10_000


def array_paths(schema: object, path: str = "") -> set[str]:
    """Paths of the members that a JSON Schema declares as arrays of objects, such as ``a[].b``."""
    found: set[str] = set()
    if not isinstance(schema, dict):
        return found
    items = schema.get("items")
    if isinstance(items, dict):
        if isinstance(items.get("properties"), dict) or items.get("type") == "object":
            found.add(path)
        found |= array_paths(items, f"{path}[]")
    for name, sub in (schema.get("properties") or {}).items():
        found |= array_paths(sub, f"{path}.{name}" if path else name)
    for kind in ("anyOf", "oneOf", "allOf"):
        for sub in schema.get(kind) or []:
            found |= array_paths(sub, path)
    return found


def catalog_arrays(catalog: DataFrame) -> dict[str, frozenset[str]]:
    """Array-of-object paths by schema_name; names are compared without case and outer blanks."""
    rows = catalog.select("schema_name", "schema_json").where("schema_name is not null and schema_json is not null").limit(MAX_SCHEMAS + 1).collect()
    if len(rows) > MAX_SCHEMAS:
        raise ValueError(f"schema_catalog has more than {MAX_SCHEMAS} rows")
    out: dict[str, frozenset[str]] = {}
    for r in rows:
        try:
            schema = json.loads(r["schema_json"])
        except ValueError:
            continue
        if isinstance(schema, dict) and "schema_definition" in schema:
            schema = schema["schema_definition"]
        name = r["schema_name"].strip().lower()
        out[name] = out.get(name, frozenset()) | frozenset(array_paths(schema))
    return out


class Number(str):
    """A number as the record writes it."""


def parse_record(text: str | None, exact: bool = True) -> object:
    """The JSON value of ``text``, also if it is kept inside JSON strings; None if it is broken. ``exact`` keeps numbers as they are written."""
    value: object = text
    how = {"parse_int": Number, "parse_float": Number, "parse_constant": Number} if exact else {}
    try:
        while type(value) is str:
            value = json.loads(value, strict=False, **how)
    except (ValueError, RecursionError):
        return None
    return value


def as_json(value: object) -> str:
    """A scalar, or an empty list or object, as JSON text."""
    return str(value) if isinstance(value, Number) else json.dumps(value, ensure_ascii=False)


def member_name(owner: str, key: str) -> str:
    """The dotted name of a member; keys with signs of their own are quoted."""
    part = key if key and not set(key) & set('.[]"') else json.dumps(key, ensure_ascii=False)
    return f"{owner}.{part}" if owner else part


def record_rows(record: object, arrays: frozenset[str], items_only: bool = False) -> list[tuple[str, str, str, int, int, int, dict[str, str]]]:
    """(list_path, kind, child_path, level, pre, post, fields) of the root and of every list item of a record.

    level counts the items around the row, itself included. fields has the members that are no list items as JSON text; the
    value of a scalar has an empty name. A lone object at a path of ``arrays`` counts as a list of one. ``items_only`` gives
    the objects in lists without their fields.
    """
    if not isinstance(record, (dict, list)):
        return []
    out: list[list] = []
    clock = 0
    # (value, path, path without numbers, is item, level, owner, name inside the owner); a path of None closes a row
    stack: list[tuple] = [(record, "", "", False, 0, None, "")]
    while stack:
        value, path, general, is_item, level, owner, name = stack.pop()
        clock += 1
        if path is None:
            value[5] = clock
            continue
        row = None
        if owner is None:
            row = ["", ROOT, "", 0, clock, 0, {}]
        elif isinstance(value, dict) and (is_item or general in arrays):
            kind = ITEM if is_item else LONE
            if not is_item:
                path, general = f"{path}[0]", f"{general}[]"
            level += 1
            row = [general[:-2], kind, path, level, clock, 0, {}]
        elif is_item and not items_only:
            # it is inside the item around it, but nothing has it for a parent
            inner = [general[:-2], LIST if isinstance(value, list) else VALUE, path, level + 1, clock, 0, {}]
            if not isinstance(value, list):
                inner[6][""] = as_json(value)
            out.append(inner)
            stack.append((inner, None, None, None, None, None, None))
        if row is not None:
            out.append(row)
            stack.append((row, None, None, None, None, None, None))
            owner, name = row, ""
        if isinstance(value, dict):
            if not value and row is None:
                owner[6][name] = "{}"
            for key in reversed(value):
                stack.append((value[key], f"{path}.{key}" if path else key, f"{general}.{key}" if general else key, False, level, owner, member_name(name, key)))
        elif isinstance(value, list):
            if not value and row is None and not is_item:
                owner[6][name] = "[]"
            for i in range(len(value) - 1, -1, -1):
                stack.append((value[i], f"{path}[{i}]", f"{general}[]", True, level, owner, None))
        elif not is_item and not items_only:
            owner[6][name] = as_json(value)
    return [tuple(x) for x in out if not items_only or x[1] != ROOT]


def nodes(records: DataFrame, catalog: DataFrame, items_only: bool = False) -> DataFrame:
    """The rows of every record with their interval labels (``NODE_SCHEMA``)."""
    arrays = catalog_arrays(catalog)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_no", "list_path", "kind", "child_path", "level", "pre", "post", "fields"]
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string())]
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for doc_no, schema, text in zip(*(c.to_pylist() for c in batch.columns)):
                known = arrays.get((schema or "").strip().lower(), frozenset())
                for *row, fields in record_rows(parse_record(text, not items_only), known, items_only):
                    for col, x in zip(cols, (doc_no, *row, list(fields.items()))):
                        col.append(x)
                if len(cols[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
                    cols = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    source = records.select(F.col("doc_no").cast("bigint"), F.col("schema_name").cast("string"), F.col("gold_data").cast("string")).where("doc_no is not null and gold_data is not null")
    return source.mapInArrow(run, NODE_SCHEMA)


def link(rows: DataFrame, *keep: str) -> DataFrame:
    """(doc_no, parent_path, child_path, *keep): each row with the nearest item that contains it; null for the root.

    Of the items one level up, the one that starts last before a node is the only one that can contain
    it. Each object goes, as a possible parent, to the group of its level and each row, as a child, to that of the
    level above; one ordered pass over a group finds the parent, and the intervals confirm it. The work is
    linear in the number of nodes; a group is one level of one record.
    """
    # one pass over the nodes: each is once a child (role true) and, if it is an object, once a possible parent (role false)
    both = F.when(F.col("kind").isin(VALUE, LIST), F.array(F.lit(True))).otherwise(F.array(F.lit(False), F.lit(True)))
    roles = rows.withColumn("_child", F.explode(both)).withColumn("_up", F.when(F.col("_child"), F.col("level") - 1).otherwise(F.col("level")))
    before = Window.partitionBy("doc_no", "_up").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    around = F.last(F.when(~F.col("_child"), F.struct("child_path", "post")), ignorenulls=True).over(before)
    found = roles.withColumn("_parent", around).where(F.col("_child") & ((F.col("level") <= 1) | (F.col("_parent.post") > F.col("post"))))
    return found.select("doc_no", F.when(F.col("level") == 1, "").when(F.col("level") > 1, F.col("_parent.child_path")).alias("parent_path"), "child_path", *keep)


def p6_found(records: DataFrame, catalog: DataFrame) -> DataFrame:
    """(doc_no, parent_path, child_path) of every object that is a list item.

    Records with null, empty or broken JSON give no rows, nor do empty lists and items that are not objects.
    doc_no is taken as the record's key; rows with a null doc_no are left out. JSON nested deeper than
    the parser's recursion limit counts as broken. Other columns play no part.
    """
    return link(nodes(records, catalog, items_only=True).select("doc_no", "kind", "child_path", "level", "pre", "post"))


def all_tables(records: DataFrame, catalog: DataFrame) -> DataFrame:
    """The rows of all tables: (list_path, kind, doc_no, child_path, parent_path, pre, post, fields).

    list_path names the table, the root's is empty; (doc_no, child_path) is a row's key and (doc_no, parent_path) that of the parent row. The
    rows of a record hold all of it: pre gives their order, fields their members as JSON text. Nulls, empty tables and extra columns as in p6_found().
    """
    return link(nodes(records, catalog), "list_path", "kind", "pre", "post", "fields")


def flat_tables(records: DataFrame, catalog: DataFrame) -> DataFrame:
    """all_tables() of the objects in lists only: (list_path, doc_no, child_path, parent_path, pre, post, fields)."""
    return link(nodes(records, catalog).where(F.col("kind").isin(ITEM, LONE)), "list_path", "pre", "post", "fields")


def cells(tables: DataFrame) -> DataFrame:
    """(list_path, doc_no, child_path, parent_path, name, value): the flat tables with a row per member."""
    return tables.select("list_path", "doc_no", "child_path", "parent_path", F.explode("fields").alias("name", "value"))


def item_path(field_key: Column) -> Column:
    """The innermost list item that a field key such as ``a[0].b[1].c`` lies in; empty outside lists.

    A key that ends in an item number names the item's own value, so its owner is the item around it.
    """
    return F.regexp_extract(F.regexp_replace(field_key, r"\[\d+\]$", ""), r"^(.*\])[^\]]*$", 1)


def p6_scores_by_list(records: DataFrame, catalog: DataFrame, scores: DataFrame) -> DataFrame:
    """(list_path, scores, attached, mean_score) per list: field scores attached to their item's row.

    Scores of array averages (``._array_avg``) are no leaves and are left out, scores outside lists too.
    attached counts the scores whose item exists in the flat tables; a null score enters no mean.
    """
    items = nodes(records, catalog, items_only=True).select("doc_no", "child_path").distinct()
    leaf = scores.where(~F.col("field_key").endswith("._array_avg")).select("doc_no", "score", item_path(F.col("field_key")).alias("child_path")).where("child_path <> ''")
    joined = leaf.join(items.withColumn("hit", F.lit(1)), ["doc_no", "child_path"], "left")
    return joined.groupBy(F.regexp_replace(F.regexp_replace("child_path", r"\[\d+\]", "[]"), r"\[\]$", "").alias("list_path")).agg(F.count("*").alias("scores"), F.count("hit").alias("attached"), F.round(F.sum(F.col("score").cast("decimal(20,12)")).cast("double") / F.count("score"), 6).alias("mean_score"))

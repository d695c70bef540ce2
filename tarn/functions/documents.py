"""JSON, XML and network addresses. Functions that need Python take Arrow batches."""

from __future__ import annotations

import ipaddress
import json
import xml.etree.ElementTree as ET
from functools import wraps

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf as spark_pandas_udf

from tarn.functions import jsonpath
from tarn.workspace import ship


def pandas_udf(kind: str):
    """As Spark's, but made where it is called, so that modules import without a session."""

    def decorate(f):
        @wraps(f)
        def call(*cols: Column) -> Column:
            ship(SparkSession.active())
            return spark_pandas_udf(f, kind)(*cols)

        return call

    return decorate


def dumps(x) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


# JSON ----------------------------------------------------------------------------------------------------------------------
def json_get(doc: Column, key: str) -> Column:
    """doc -> key, as JSON text."""
    return F.to_json(F.try_variant_get(F.try_parse_json(doc), f'$["{key}"]', "variant"))


def json_get_text(doc: Column, *path: str | int) -> Column:
    """doc ->> key, doc #>> path."""
    return F.get_json_object(doc, "$" + "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path))


def has_key(doc: Column, *keys: str, every: bool = False) -> Column:
    """doc ? key, doc ?| keys, doc ?& keys."""
    found = F.coalesce(F.json_object_keys(doc), F.array().cast("array<string>"))
    out = F.lit(every)
    for k in keys:
        one = F.array_contains(found, k)
        out = out & one if every else out | one
    return F.when(doc.isNotNull(), out)


def json_build_object(**members: Column) -> Column:
    """NULL members are kept."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in members.items())), {"ignoreNullFields": "false"})


def row_to_json(*cols: Column) -> Column:
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def contained(big, part) -> bool:
    """Deep containment of JSON values."""
    if isinstance(part, dict):
        return isinstance(big, dict) and all(k in big and contained(big[k], v) for k, v in part.items())
    if isinstance(part, list):
        return isinstance(big, list) and all(any(contained(b, p) for b in big) for p in part)
    if isinstance(big, list):
        return part in big
    return type(big) is type(part) and big == part


@pandas_udf("boolean")
def json_contains(doc: pd.Series, part: pd.Series) -> pd.Series:
    """doc @> part."""
    return pd.Series([None if a is None or b is None else contained(json.loads(a), json.loads(b)) for a, b in zip(doc, part, strict=True)], dtype=object)


def set_path(doc, path: list[str], value, create: bool = True):
    """A copy of doc with the value at a path; objects by key, arrays by number (negative from the end).

    With create, parents that are missing, or are neither object nor array, become objects.
    """
    if not path:
        return value
    key, rest = path[0], path[1:]
    if isinstance(doc, dict):
        if key not in doc and not create:
            return doc
        child = doc.get(key)
        if rest and create and not isinstance(child, (dict, list)):
            child = {}
        return doc | {key: set_path(child, rest, value, create)}
    if isinstance(doc, list):
        i = int(key)
        i = i + len(doc) if i < 0 else i
        if 0 <= i < len(doc):
            return [*doc[:i], set_path(doc[i], rest, value, create), *doc[i + 1 :]]
        return ([value, *doc] if i < 0 else [*doc, value]) if create and not rest else doc
    return doc


def jsonb_set(doc: Column, path: list[str], value: Column, create: bool = True) -> Column:
    @pandas_udf("string")
    def run(docs: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([None if d is None or v is None else dumps(set_path(json.loads(d), path, json.loads(v), create)) for d, v in zip(docs, values, strict=True)], dtype=object)

    return run(doc, value)


def jsonb_path_query(doc: Column, path: str, variables: str | None = None) -> Column:
    """An array of JSON texts, to be exploded."""
    jsonpath.compiled(path)

    @pandas_udf("array<string>")
    def run(docs: pd.Series) -> pd.Series:
        return pd.Series([[dumps(x) for x in jsonpath.query(d, path, variables)] for d in docs])

    return run(doc)


def jsonb_path_exists(doc: Column, path: str, variables: str | None = None) -> Column:
    """Errors of the path on a document count as not there."""
    jsonpath.compiled(path)

    @pandas_udf("boolean")
    def run(docs: pd.Series) -> pd.Series:
        def one(d):
            try:
                return None if d is None else bool(jsonpath.query(d, path, variables))
            except jsonpath.PathError:
                return False

        return pd.Series([one(d) for d in docs], dtype=object)

    return run(doc)


# XML -----------------------------------------------------------------------------------------------------------------------
def well_formed(s: str | None, document: bool) -> bool | None:
    if s is None:
        return None
    try:
        ET.fromstring(s if document else f"<_>{s}</_>")
    except ET.ParseError:
        return False
    return True


@pandas_udf("boolean")
def xml_is_well_formed_document(s: pd.Series) -> pd.Series:
    return pd.Series([well_formed(x, True) for x in s], dtype=object)


@pandas_udf("boolean")
def xml_is_well_formed_content(s: pd.Series) -> pd.Series:
    return pd.Series([well_formed(x, False) for x in s], dtype=object)


def xmlparse(s: Column) -> Column:
    """The text, if it is a document; else an error."""
    return F.when(s.isNull() | xml_is_well_formed_document(s), s).otherwise(F.raise_error(F.lit("invalid XML document")))


def xmlserialize(x: Column) -> Column:
    return x.cast("string")


def xpath(x: Column, path: str) -> Column:
    """Texts that the path finds."""
    return F.xpath(x, F.lit(path if path.endswith("text()") or "@" in path.rsplit("/", 1)[-1] else f"{path}/text()"))


def xpath_exists(x: Column, path: str) -> Column:
    return F.xpath_boolean(x, F.lit(path))


# Network addresses ------------------------------------------------------------------------------------------------------------
def _address(f, kind: str):
    @pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f(ipaddress.ip_interface(x)) for x in s], dtype=object)

    return run


host = _address(lambda i: str(i.ip), "string")
family = _address(lambda i: 4 if i.version == 4 else 6, "int")
masklen = _address(lambda i: i.network.prefixlen, "int")
network = _address(lambda i: str(i.network), "string")


@pandas_udf("boolean")
def contained_by_or_equal(inner: pd.Series, outer: pd.Series) -> pd.Series:
    """inner <<= outer."""

    def one(a, b):
        if a is None or b is None:
            return None
        a, b = ipaddress.ip_interface(a).network, ipaddress.ip_interface(b).network
        return a.version == b.version and a.subnet_of(b)

    return pd.Series([one(a, b) for a, b in zip(inner, outer, strict=True)], dtype=object)

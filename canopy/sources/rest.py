"""REST requests and answers as rows: verbs to operations, results to text, event streams, SDK frames."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy import model
from canopy.functions.jsontext import INVALID, dump, parse
from canopy.functions.ids import push_id


def to_operations(requests: DataFrame) -> DataFrame:
    """method, path (``*.json``), body, ts_ms, request_id -> op, path, value, name (of a POST), h, hp.

    GET reads (o), PUT sets, PATCH updates, DELETE deletes, POST sets below a new push id.
    ``if_match`` makes any write conditional: ``h`` is the hash that the present value must have,
    and ``hp`` says that there is one (the tag ``null_etag``, or an empty one, stands for no value);
    a DELETE under it is a SET of null. Other methods and paths give no row.
    """
    path = F.regexp_replace("path", r"\.json$", "")
    op = F.create_map(*[F.lit(x) for x in ("GET", "o", "PUT", "s", "POST", "s", "PATCH", "u", "DELETE", "d")])[F.upper("method")]
    name = F.when(F.upper("method") == "POST", push_id(F.col("ts_ms"), F.col("request_id")))
    tag = F.col("if_match") if "if_match" in requests.columns else F.lit(None).cast("string")
    conditional = tag.isNotNull() & (op != "o")
    plain = F.btrim(F.regexp_replace(tag, "^W/", ""), F.lit('"'))
    h = F.when(conditional, F.when(plain == "null_etag", "").otherwise(plain))
    value = F.when((op == "d") & conditional, "null").when(~op.isin("o", "d"), F.col("body"))
    r = requests.filter(F.col("path").endswith(".json")).select("request_id", F.when((op == "d") & conditional, "s").otherwise(op).alias("op"), model.joined(path, F.coalesce(name, F.lit(""))).alias("path"), value.alias("value"), name.alias("name"), h.alias("h"), conditional.alias("hp"))
    return r.filter("op is not null")


@F.pandas_udf(T.StringType())
def _indented(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if (v := parse(t)) is INVALID else pretty_text(v))


def pretty_text(value) -> str:
    """A value over several lines, two spaces a level, keys in byte order; empty containers stay short. Any depth."""
    out: list[str] = []
    todo: list[tuple[str, object, int]] = [("", value, 0)]
    while todo:
        head, v, level = todo.pop()
        out.append(head)
        if not isinstance(v, (dict, list)) or not v:
            out.append("" if v is _DONE else dump(v))
            continue
        pad, close = "\n" + "  " * (level + 1), "\n" + "  " * level + ("}" if isinstance(v, dict) else "]")
        pairs = [(f"{dump(k)}: ", v[k]) for k in sorted(v)] if isinstance(v, dict) else [("", x) for x in v]
        todo.append((close, _DONE, level))
        for i in range(len(pairs) - 1, -1, -1):
            todo.append((("," if i else "") + pad + pairs[i][0], pairs[i][1], level + 1))
        out.append("{" if isinstance(v, dict) else "[")
    return "".join(out)


_DONE = object()


def formatted(json_col: Column, print_: str | None = None, callback: str | None = None) -> Column:
    """A JSON text as an answer: plain, ``pretty`` (over several lines), ``silent`` (empty), or wrapped in a callback."""
    if print_ == "silent":
        return F.lit("")
    text = _indented(json_col) if print_ == "pretty" else json_col
    return F.concat(F.lit(f"{callback}("), text, F.lit(");")) if callback else text


def headers(params: dict[str, str]) -> dict[str, str]:
    """The answer's headers under REST parameters: its type, and the file name of a download."""
    out = {"Content-Type": "application/javascript; charset=utf-8" if params.get("callback") else "application/json; charset=utf-8"}
    if params.get("download"):
        name = params["download"].replace("\\", "").replace('"', "")
        out["Content-Disposition"] = f'attachment; filename="{name}"'
    return out


def sse(event: Column, path: Column, data: Column) -> Column:
    """``event:`` and ``data:`` lines of one put or patch."""
    quoted = F.to_json(F.array(path))
    return F.concat(F.lit("event: "), event, F.lit('\ndata: {"path":'), F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit(',"data":'), F.coalesce(data, F.lit("null")), F.lit("}\n\n"))


def parse_sse(text: Column) -> Column:
    """event, path and data of one event text."""
    body = F.try_parse_json(F.regexp_extract(text, r"(?m)^data: ?(.*)$", 1))
    return F.struct(F.regexp_extract(text, r"(?m)^event: ?(.*)$", 1).alias("event"), F.try_variant_get(body, "$.path", "string").alias("path"), F.to_json(F.try_variant_get(body, "$.data", "variant")).alias("data"))


def sdk_operations(frames: DataFrame) -> DataFrame:
    """SDK frames (action, path, body) as operations; a merge over several paths is a transaction."""
    kind = {"q": "sb", "n": "us", "g": "o", "p": "s", "m": "u", "o": "od-s", "om": "od-u", "oc": "od-c"}
    op = F.create_map(*[F.lit(x) for kv in kind.items() for x in kv])[F.col("action")]
    many = (F.col("action") == "m") & F.exists(F.coalesce(F.map_keys(F.from_json("body", "map<string,string>")), F.array().cast("array<string>")), lambda k: F.contains(k, F.lit("/")))
    return frames.select("*", F.when(many, "tx").otherwise(op).alias("op")).filter("op is not null")


def answer_options(params: dict[str, str]) -> dict[str, object]:
    """The checked parameters of an answer: print, callback, download, shallow, and timeout in seconds.

    A ``print`` other than pretty or silent, and a timeout that is no positive ``ms``, ``s`` or ``min`` up to a quarter of an hour, raise.
    """
    out: dict[str, object] = {k: params[k] for k in ("callback", "download") if params.get(k)}
    if params.get("print"):
        if params["print"] not in ("pretty", "silent"):
            raise ValueError(f"print is pretty or silent, not {params['print']}")
        out["print"] = params["print"]
    if params.get("timeout"):
        m = re.fullmatch(r"([0-9]+)(ms|s|min)", params["timeout"])
        seconds = int(m[1]) * {"ms": 0.001, "s": 1, "min": 60}[m[2]] if m else 0
        if not 0 < seconds <= 900:
            raise ValueError(f"no timeout: {params['timeout']}")
        out["timeout"] = seconds
    out["shallow"] = params.get("shallow") == "true"
    return out

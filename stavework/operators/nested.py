"""Deeply nested JSON to linked flat rows by vectorised structural indexing.

The payloads of a batch lie in one byte buffer. Bitmaps of quotes (escapes resolved by the parity of backslash runs),
brackets and delimiters are built with NumPy; the parity of quotes up to each byte tells strings from structure, and
the prefix sum of brackets is the nesting depth. A search by (depth, place) gives each token the container around it,
so that grammar, array positions and parents are array operations too. Paths are joined level by level with Arrow's
string functions. Python touches single values only where a string may hold JSON itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys whose value is an array by the schema of review payloads; a single value there is element 0.
ARRAY_KEYS = ("events", "issues", "lyrics", "measures", "notes", "parts", "pitches", "repairs", "staves", "voices")
#: Level of the elements of an array.
LEVELS = {"staves": "staff", "measures": "measure", "events": "event", "issues": "issue", "pitches": "pitch"}
#: Level of an object under a key, and of which array's elements alone it is one.
OBJECTS = {"bbox": ("bbox", None), "pitch": ("pitch", "notes")}

NODE_SCHEMA = "node_level string, node_path string, parent_level string, parent_path string, position int, value string"
#: Bytes indexed at once; about 60 bytes of arrays for each.
BATCH = 1 << 20

_OPEN_OBJECT, _CLOSE_OBJECT, _OPEN_ARRAY, _CLOSE_ARRAY, _COMMA, _COLON, _STRING, _SCALAR, _START = range(9)
_CODE = np.full(256, -1, np.int8)
for _i, _b in enumerate(b"{}[],:"):
    _CODE[_b] = _i
_SPACE = np.isin(np.arange(256), [9, 10, 13, 32])
_HEX = np.isin(np.arange(256), list(b"0123456789abcdefABCDEF"))
_ESCAPE = np.isin(np.arange(256), list(b'"\\/bfnrtu'))
_PLAIN = r"^(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)$"


def _slices(buf: np.ndarray, start: np.ndarray, end: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The spans of the buffer as an Arrow array."""
    size = end - start
    offsets = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - start, size)
    return pa.Array.from_buffers(kind, len(start), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(buf[at])])


class Index:
    """The values of JSON texts in the order of their places: type, span, parent, key and array position, all as arrays.

    ``valid`` tells which texts are JSON (by RFC 8259: one value, no NaN, no control characters in strings); only
    these have values. There is no limit of depth.
    """

    def __init__(self, texts: list[bytes]):
        self.valid = np.zeros(len(texts), bool)
        docs = np.arange(len(texts))
        self._read(texts)
        if not self.balanced.all():  # an open bracket or string would reach into the next text
            docs = np.flatnonzero(self.balanced)
            self._read([texts[i] for i in docs])
        valid = self._grammar()
        self.valid[docs[valid]] = True
        self._values(valid, docs)

    def _read(self, texts: list[bytes]) -> None:
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        last = np.cumsum(sizes) - 1
        self.buf = buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        at = np.arange(len(buf), dtype=np.int32)
        # escapes: a byte after an odd run of backslashes
        slash = buf == 92
        self.escaped = escaped = np.zeros(len(buf), bool)
        if slash.any():
            run = at - np.maximum.accumulate(np.where(slash, -1, at))
            escaped[1:] = run[:-1] & 1
        quote = (buf == 34) & ~escaped
        seen = np.cumsum(quote, dtype=np.int32)
        self.doc_of = doc_of = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        before = np.concatenate(([0], seen))[last - sizes + 1].astype(np.int32)
        self.inside = inside = ((seen - before[doc_of]) & 1).astype(bool)  # from the opening quote up to the byte before the closing one
        code = np.where(inside | quote, np.int8(-1), _CODE[buf])
        step = ((code == _OPEN_OBJECT) | (code == _OPEN_ARRAY)).astype(np.int8) - ((code == _CLOSE_OBJECT) | (code == _CLOSE_ARRAY)).astype(np.int8)
        depth = np.cumsum(step, dtype=np.int32)
        outer = np.concatenate(([0], depth))[last - sizes + 1].astype(np.int32)
        self.depth = depth - outer[doc_of]
        self.balanced = ~inside[last] & (self.depth[last] == 0)
        if len(texts):
            self.balanced &= np.minimum.reduceat(self.depth, last - sizes + 1) >= 0
        self.quotes = np.flatnonzero(quote)
        scalar = ~inside & ~quote & (code < 0) & ~_SPACE[buf]
        edge = np.diff(scalar.astype(np.int8), prepend=0, append=0)
        self.scalar_start, self.scalar_end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        token = code >= 0
        token[self.scalar_start] = True
        token[self.quotes] |= inside[self.quotes]
        self.at = np.flatnonzero(token)
        self.type = code[self.at]
        other = self.type < 0
        self.type[other] = np.where(buf[self.at[other]] == 34, _STRING, _SCALAR)

    def _grammar(self) -> np.ndarray:
        """Which texts are JSON; the container around each token on the way."""
        n, m = len(self.balanced), len(self.buf) + 1
        valid = np.zeros(n, bool)
        valid[self.doc_of[self.at]] = True  # no token, no value
        wrong = lambda places: valid.__setitem__(self.doc_of[places], False)
        # within strings: control characters and escapes
        wrong(np.flatnonzero(self.inside & (self.buf < 32)))
        e = np.flatnonzero(self.escaped & self.inside)
        wrong(e[~_ESCAPE[self.buf[e]]])
        u = e[self.buf[e] == 117]
        for k in range(1, 5):
            wrong(u[~_HEX[self.buf[np.minimum(u + k, m - 2)]]])
        bad = pc.invert(pc.match_substring_regex(_slices(self.buf, self.scalar_start, self.scalar_end, pa.binary()), _PLAIN)).to_numpy(zero_copy_only=False)
        wrong(self.scalar_start[bad])
        # brackets: the k-th that closes at a depth closes the k-th that opens there
        t, at = self.type, self.at
        opening, closing = (t == _OPEN_OBJECT) | (t == _OPEN_ARRAY), (t == _CLOSE_OBJECT) | (t == _CLOSE_ARRAY)
        level = self.depth[at].astype(np.int64) - opening  # of what lies around a token
        o, c = np.flatnonzero(opening), np.flatnonzero(closing)
        o = o[np.argsort(level[o], kind="stable")]
        c = c[np.argsort(level[c], kind="stable")]
        wrong(at[c[t[c] != t[o] + 1]])
        self.close = np.full(len(t), -1)
        self.close[o] = at[c]
        # the container of a token: the last that opened one level above before it
        place = np.searchsorted((level[o] + 1) * m + at[o], level * m + at) - 1
        self.around = np.where(level > 0, o[np.maximum(place, 0)] if len(o) else -1, -1)
        self.level = level
        first = np.diff(self.doc_of[at], prepend=-1) != 0
        before = np.where(first, _START, np.concatenate(([_START], t[:-1]))) if len(t) else t
        held = np.where(self.around < 0, _START, t[self.around]) if len(t) else t
        self.is_key = key = (t == _STRING) & (held == _OPEN_OBJECT) & ((before == _OPEN_OBJECT) | (before == _COMMA))
        self.is_value = value = ((t == _STRING) | (t == _SCALAR) | opening) & ~key
        ends = closing | value & ~opening
        after_value, after_key = (np.concatenate(([False], x[:-1])) & ~first for x in (ends, key))
        right = np.where(held == _START, before == _START, np.where(held == _OPEN_ARRAY, (before == _OPEN_ARRAY) | (before == _COMMA), before == _COLON))
        right = np.where(value, right, True)
        right &= (t != _COLON) | after_key
        right &= (t != _COMMA) | after_value & (held != _START)
        right &= ~closing | after_value | (before == t - 1)
        wrong(at[~right])
        return valid

    def _values(self, valid: np.ndarray, docs: np.ndarray) -> None:
        m = len(self.buf) + 1
        tok = np.flatnonzero(self.is_value & valid[self.doc_of[self.at]])
        around = self.around[tok]
        self.start, self.depth_of = self.at[tok], self.level[tok]
        self.doc = docs[self.doc_of[self.start]] if len(docs) else self.start
        self.kind = self.buf[self.start]
        number = np.full(len(self.at) + 1, -1)
        number[tok] = np.arange(len(tok))
        self.parent = number[around]
        in_array = (around >= 0) & (self.type[around] == _OPEN_ARRAY) if len(tok) else np.zeros(0, bool)
        # array position: commas of the same container before
        commas = np.flatnonzero(self.type == _COMMA)
        by = np.sort(self.around[commas].astype(np.int64) * m + self.at[commas])
        self.pos = np.where(in_array, np.searchsorted(by, around * m + self.start) - np.searchsorted(by, around * m), -1)
        # ends
        end = np.zeros(len(tok), np.int64)
        s, c = self.kind == 34, self.close[tok] >= 0
        end[s] = self.quotes[np.searchsorted(self.quotes, self.start[s]) + 1] + 1
        end[c] = self.close[tok[c]] + 1
        rest = ~s & ~c
        end[rest] = self.scalar_end[np.searchsorted(self.scalar_start, self.start[rest])]
        self.end = end
        # keys: the token before the colon; of their few texts each is decoded once
        keyed = (around >= 0) & ~in_array
        k = self.at[tok[keyed] - 2]
        spans = _slices(self.buf, k + 1, self.quotes[np.searchsorted(self.quotes, k) + 1], pa.binary()).dictionary_encode()
        names, codes = [json.loads(b'"' + x.as_py() + b'"') for x in spans.dictionary], spans.indices.to_numpy()
        self.names = list(dict.fromkeys(names))  # two ways of writing may be one key
        same = np.array([self.names.index(x) for x in names], np.int64)
        self.key = np.full(len(tok), -1)
        self.key[keyed] = same[codes] if len(codes) else codes
        # of equal keys in an object the last holds
        self.last = np.ones(len(tok), bool)
        own = np.flatnonzero(keyed)
        order = own[np.lexsort((self.start[own], self.key[own], self.parent[own]))]
        again = (self.parent[order[1:]] == self.parent[order[:-1]]) & (self.key[order[1:]] == self.key[order[:-1]])
        self.last[order[:-1][again]] = False


def is_json(text: str) -> bool:
    """Whether the whole text is one JSON value (NaN and Infinity are not JSON)."""
    return bool(Index([text.encode("utf-8", "surrogatepass")]).valid[0])


class _Nodes:
    """The nodes found so far, in chunks; each names the number of the nearest node above it."""

    def __init__(self) -> None:
        self.n, self.record, self.level, self.path, self.above, self.position, self.value = 0, [], [], [], [], [], []

    def add(self, record: np.ndarray, level: np.ndarray, path: pa.Array, above: np.ndarray, position: np.ndarray, value: list | None) -> np.ndarray:
        for into, x in zip((self.record, self.level, self.path, self.above, self.position), (record, level, path, above, position)):
            into.append(x)
        self.value += value or ()
        self.n += len(record)
        return np.arange(self.n - len(record), self.n)


def _walk(texts: list[str | None], array_keys: tuple[str, ...], levels: dict[str, str], objects: dict[str, tuple[str, str | None]], values: bool) -> tuple[_Nodes, list[str]]:
    """The nodes of all texts that are JSON, and the names of their levels."""
    found, names = _Nodes(), sorted({*levels.values(), *(x for x, _ in objects.values())})
    own = [i for i, t in enumerate(texts) if t]
    data = [texts[i].encode("utf-8", "surrogatepass") for i in own]
    # what is known of each text's root: record, path, key of the array it is an element of or its own key, node above, array position
    roots = {"record": np.array(own, np.int64), "path": pa.array([""] * len(own), pa.string()), "top": np.ones(len(own), bool), "name": [""] * len(own), "element": np.zeros(len(own), bool), "of": [""] * len(own), "above": np.full(len(own), -1), "position": np.full(len(own), -1)}
    while data:
        ix = Index(data)
        # keys as numbers, those of the schema and of the roots included; 0 stands for none
        keys = ["", *dict.fromkeys([*array_keys, *levels, *objects, *(x for _, x in objects.values() if x), *roots["name"], *roots["of"], *ix.names])]
        number = {k: i for i, k in reversed(list(enumerate(keys)))}
        key_no = np.array([number[x] if x else len(keys) for x in ix.names] + [0])[ix.key]  # an empty key is none of the schema's
        level_no = np.array([names.index(levels[k]) if k in levels else -1 for k in keys] + [-1])
        object_no = np.array([names.index(objects[k][0]) if k in objects else -1 for k in keys] + [-1])
        object_in = np.array([number[objects[k][1]] if k in objects and objects[k][1] else -1 for k in keys] + [-1])
        is_array_key = np.array([bool(k) and k in array_keys for k in keys] + [False])
        texts_of_keys = pa.array(["" if i == 0 else k for i, k in enumerate(keys)] + [""], pa.string())
        inner = _quoted(ix)
        n = len(ix.start)
        slot, state = np.full(n, -1), None
        again: dict[str, list] = {k: [] for k in roots}
        data = []
        order = np.argsort(ix.depth_of, kind="stable")
        cuts = np.searchsorted(ix.depth_of[order], np.arange(int(ix.depth_of.max()) + 2)) if n else np.zeros(1, int)
        for a, b in zip(cuts[:-1], cuts[1:]):
            v = order[a:b]
            if state is None:
                d = ix.doc[v]
                name = np.array([number[x] for x in roots["name"]], np.int64)[d]
                of = np.array([number[x] for x in roots["of"]], np.int64)[d]
                record, element, above, position, top = (roots[k][d] for k in ("record", "element", "above", "position", "top"))
                path = roots["path"].take(pa.array(d))
            else:
                up = slot[ix.parent[v]]
                keep = (up >= 0) & ix.last[v]
                v, up = v[keep], up[keep]
                if not len(v):
                    break
                element = ix.pos[v] >= 0
                name = np.where(element, state["name"][up], key_no[v])
                of = state["own"][up]
                record, above, position = state["record"][up], state["above"][up], ix.pos[v]
                part = pc.if_else(pa.array(element), pa.array(ix.pos[v]).cast(pa.string()), texts_of_keys.take(pa.array(key_no[v])))
                path = pc.if_else(pa.array(state["top"][up]), part, pc.binary_join_element_wise(state["path"].take(pa.array(up)), part, "."))
                top = np.zeros(len(v), bool)
            kind = ix.kind[v]
            # nulls are no nodes; a string that holds JSON stands for it
            held = np.array([i in inner for i in v.tolist()], bool) if inner else np.zeros(len(v), bool)
            for i in np.flatnonzero(held).tolist():
                data.append(inner[int(v[i])])
                for k, x in (("record", record[i]), ("top", top[i]), ("element", element[i]), ("above", above[i]), ("position", position[i])):
                    again[k].append(x)
                again["name"].append(_word(keys, name[i]))
                again["of"].append(_word(keys, of[i]))
                again["path"].append(path[i].as_py())
            keep = (kind != 110) & ~held
            v, kind, name, of, record, element, above, position, top = (x[keep] for x in (v, kind, name, of, record, element, above, position, top))
            path = path.filter(pa.array(keep))
            single = is_array_key[name] & ~element & (kind != 91)
            if single.any():
                path = pc.if_else(pa.array(single), pc.binary_join_element_wise(path, "0", "."), path)
                element, position = element | single, np.where(single, 0, position)
            level = np.where(element & (kind != 91), level_no[name], -1)
            allowed = (object_in[name] < 0) | (object_in[name] == of)
            level = np.where((level < 0) & ~element & (kind == 123) & allowed, object_no[name], level)
            node = level >= 0
            if node.any():
                at = np.flatnonzero(node)
                raw = [ix.buf[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(ix.start[v[at]], ix.end[v[at]])] if values else None
                above = above.copy()
                above[at] = found.add(record[at], level[at], path.filter(pa.array(node)), above[at], np.where(element[at], position[at], -1), raw)
            # what lies within: an array hands down its key, but one within an array none
            box = (kind == 123) | (kind == 91)
            hand = np.where((kind == 91) & element, 0, name)
            slot[v[box]] = np.arange(int(box.sum()))
            state = {"path": path.filter(pa.array(box)), "own": np.where(element & (kind == 123), name, 0)[box], **{k: x[box] for k, x in (("name", hand), ("record", record), ("above", above), ("top", top))}}
        if data:
            roots = {k: x if k in ("name", "of") else pa.array(x, pa.string()) if k == "path" else np.array(x) for k, x in again.items()}
    return found, names


def _word(keys: list[str], i: int) -> str:
    return keys[i] if i < len(keys) else ""


def _quoted(ix: Index) -> dict[int, bytes]:
    """Of the strings that hold JSON of an array or object that JSON."""
    s = np.flatnonzero(ix.kind == 34)
    sign = np.concatenate(([0], np.cumsum((ix.buf == 123) | (ix.buf == 91) | (ix.buf == 92))))
    s = s[sign[ix.end[s]] > sign[ix.start[s]]]
    texts = {}
    for i in s.tolist():
        text = json.loads(ix.buf[ix.start[i] : ix.end[i]].tobytes())
        if text.lstrip(" \t\r\n")[:1] in ("[", "{"):
            texts[i] = text.encode("utf-8", "surrogatepass")
    if not texts:
        return {}
    return {i: t for (i, t), ok in zip(texts.items(), Index(list(texts.values())).valid) if ok}


def flatten_nested(df: DataFrame, record: str, payload: str, array_keys: tuple[str, ...] = ARRAY_KEYS, levels: dict[str, str] = LEVELS, objects: dict[str, tuple[str, str | None]] = OBJECTS, values: bool = True) -> DataFrame:
    """One row for each node of each record, tied to its parent.

    Returns ``record, node_level, node_path, parent_level, parent_path, position, value``; ``value`` is the node's own
    JSON, null without ``values``. ``parent_*`` name the nearest node above (null at the top). Nodes are the elements of
    the arrays in ``levels`` and the objects under the keys in ``objects``. Defined results: null, empty, broken
    payloads and JSON scalars have no nodes; nulls are no nodes but keep their array positions; a single value where an
    array belongs (``array_keys``) is its element 0; a string that holds JSON of an array or object stands for it, at
    any depth of such quoting; of equal keys in one object the last holds; elements of arrays within arrays have no
    level. ``record`` must be unique: deduplicate before. Other columns are ignored, whatever their names.

    Narrow: one scan, no shuffle. Payloads are indexed about BATCH bytes at once; one longer than that is indexed alone.
    """
    kind = dict(df.dtypes)[record]
    schema = f"`{record}` {kind}, {NODE_SCHEMA}"
    columns = [record, "node_level", "node_path", "parent_level", "parent_path", "position", "value"]

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found, names = _walk(batch.column(1).to_pylist(), array_keys, levels, objects, values)
        if not found.n:
            return None
        level, path = np.concatenate(found.level), pa.concat_arrays(found.path)
        above, position = np.concatenate(found.above), np.concatenate(found.position)
        words = pa.array(names, pa.string())
        none = above < 0
        arrays = [
            batch.column(0).take(pa.array(np.concatenate(found.record))), words.take(pa.array(level)), path,
            words.take(pa.array(level[above], mask=none)), path.take(pa.array(above, mask=none)),
            pa.array(position.astype(np.int32), mask=position < 0), pa.array(found.value or [None] * found.n, pa.string()),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False))
            cuts = [0, *(np.flatnonzero(np.diff(upto // BATCH)) + 1).tolist(), b.num_rows]
            for x, y in zip(cuts[:-1], cuts[1:]):
                out = rows(b.slice(x, y - x)) if y > x else None
                if out is not None:
                    yield out

    return df.select(F.col(f"`{record}`"), F.col(f"`{payload}`")).mapInArrow(run, schema)


#: Typed columns of each level: name -> (JSON path in the node's value, type).
TABLES = {
    "staff": {"number": ("$.number", "int")},
    "measure": {"m_index": ("$.index", "int"), "m_number": ("$.number", "string"), "measure_id": ("$.id", "string"), "part": ("$.part", "string"), "staff_no": ("$.staff", "int"), "priority": ("$.priority", "double")},
    "event": {"kind": ("$.kind", "string"), "offset_q": ("$.offset", "string"), "confidence": ("$.confidence", "double")},
    "pitch": {"step": ("$.step", "string"), "alter_by": ("$.alter", "int"), "octave": ("$.octave", "int")},
    "bbox": {"page": ("$.page", "int"), "x": ("$.x", "double"), "y": ("$.y", "double"), "w": ("$.w", "double"), "h": ("$.h", "double")},
    "issue": {"kind": ("$.kind", "string"), "detail": ("$.detail", "string")},
}


def level_table(nodes: DataFrame, level: str, record: str) -> DataFrame:
    """The flat table of one level: keys, parent link and typed columns; a field of the wrong type is null.

    A pitch given as text (``"F#4"``) has it in ``label``.
    """
    cols = [F.expr(f"try_cast(get_json_object(value, '{path}') AS {kind})").alias(name) for name, (path, kind) in TABLES[level].items()]
    if level == "pitch":
        cols.append(F.when(F.col("value").startswith('"'), F.expr("get_json_object(concat('[', value, ']'), '$[0]')")).alias("label"))
    return nodes.filter(F.col("node_level") == level).select(record, "node_path", "parent_level", "parent_path", "position", *cols)

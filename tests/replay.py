"""Sequential replay of a feed into a dict tree: the brute-force side of the feed tests."""

import json


def _parse(text):
    def bad(x):
        raise ValueError(x)

    try:
        return json.loads(text, parse_constant=bad)
    except ValueError:
        return KeyError


def _flat(path, v, out):
    if isinstance(v, dict):
        for k, x in v.items():
            _flat(f"{path}/{k}".strip("/"), x, out)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            _flat(f"{path}/{i}".strip("/"), x, out)
    elif v is not None:
        out[path] = v


def _put(state, path, value, pos):
    new = {}
    _flat(path, value, new)
    for p in [p for p in state if path == "" or p == path or p.startswith(path + "/")]:
        del state[p]
    for p in new:
        parts = p.split("/")
        for i in range(len(parts)):
            state.pop("/".join(parts[:i]), None)
        state.pop(p, None)
        state[p] = (new[p], pos)


def replay(rows):
    """rows of (project, database, sequence, line_no, op, path, value) in any order -> {(p, d, '/path'): (value, (sequence, line_no))}"""
    dbs = {}
    seen = {}
    for p, d, s, n, op, path, value in rows:
        if None in (p, d, s, n, op, path):
            continue
        if op in "su" and value is not None and _parse(value) is KeyError:
            continue
        seen.setdefault((p, d, s, n), (op, path, value))
    for (p, d, s, n), (op, path, value) in sorted(seen.items()):
        state = dbs.setdefault((p, d), {})
        path = path.strip("/")
        if op == "d":
            _put(state, path, None, (s, n))
        elif op == "s":
            _put(state, path, None if value is None else _parse(value), (s, n))
        elif op == "u" and value is not None and isinstance(v := _parse(value), dict):
            for k in sorted(v):
                _put(state, f"{path}/{k.strip('/')}".strip("/"), v[k], (s, n))
    return {(*db, "/" + path): x for db, state in dbs.items() for path, x in state.items()}

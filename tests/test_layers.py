"""Layered scripts: chains that are built here and must come back, and sources without any."""

import base64
import codecs
import json
import random

from lurescope.operators import layers

b64 = lambda t: base64.b64encode(t if isinstance(t, bytes) else t.encode()).decode()
JS = {
    "b64": "x=atob(x);", "reverse": "x=x.split('').reverse().join('');", "rot13": "x=x.replace(/[a-z]/gi,c=>String.fromCharCode((c.charCodeAt(0)-b+13)%26+b));",
    "json_parse": "x=JSON.parse(x).join('-');",
}


def hide(text, steps):
    """The seed that the steps turn into ``text``."""
    for name, key in reversed(steps):
        if name == "b64":
            text = b64(text)
        if name == "hex_xor":
            text = b64("".join(f"{ord(c) ^ key:02x}" for c in text))
        if name == "reverse":
            text = text[::-1]
        if name == "rot13":
            text = codecs.encode(text, "rot_13")
        if name == "json_parse":
            text = json.dumps(text.split("-"))
    return text


def source(seed, steps, more=""):
    code = "".join(f"x=atob(x).match(/../g).map(p=>String.fromCharCode(parseInt(p, 16) ^ {k})).join('');" if n == "hex_xor" else JS[n] for n, k in steps)
    return f"{more}var x='{seed}';{code}"


def test_recorded_steps_are_replayed(spark):
    r = random.Random(1)
    rows, want = [], {}
    for i in range(25):
        steps = [("b64", None)] + [(n, r.randrange(1, 128) if n == "hex_xor" else None) for n in r.choices(["b64", "hex_xor", "reverse", "rot13"], k=r.randint(0, 4))] + [r.choice([("hex_xor", 90), ("reverse", None)])]
        text = f'window.location="https://evil.example/{i}?q=a-b";'
        rows.append((i, source(hide(text, steps), steps, "var y='QUJDREVGR0hJSktMTU5PUFFSU1RVVldY';" if i % 2 else "")))
        want[i] = (text, [n for n, _ in steps])
    steps = [("b64", None), ("json_parse", None)]
    rows.append((50, source(hide("function f()-{return 1}-end of it", steps), steps)))
    want[50] = ("function f()-{return 1}-end of it", ["b64", "json_parse"])
    rows += [(90, "plain text"), (91, None), (92, ""), (93, source("notbase64!!notbase64", steps)), (94, source(b64("just words, nothing more here"), [("b64", None), ("reverse", None)])), (95, source(b64("var hidden = 1; but no step"), [("b64", None)]))]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "id int, body string, steps string")
    got = {x["id"]: (x["plaintext"], x["steps"]) for x in layers.replay(df, "id", "body").collect()}
    assert got == want
    assert layers.replay(df.limit(0), "id", "body").count() == 0


def test_keys_are_searched_among_strings(spark):
    r = random.Random(2)
    xor = lambda data, key: bytes(c ^ key[i % len(key)] for i, c in enumerate(data))
    rows, want = [], {}
    for i in range(6):
        key = bytes(r.randrange(256) for _ in range(12 + 7 * i))
        text = f"function go(){{ location='https://evil.example/é{i}' }} // " + "x" * r.randint(0, 60)
        rows.append((i, f"let c=\"{b64(xor(text.encode(), key))}\",k=\"{b64(key)}\",o='{b64('an incidental string')}';for(i=0;i<n;i++)p[i]=c[i] ^ k[i % k.length];"))
        want[i] = text
    rows += [(20, rows[0][1].replace("^", "+")), (21, None), (22, "p[i] = c[i] ^ k[i % k.length]; 'QUJDREVGR0hJSktMTU5PUFFS'")]
    df = spark.createDataFrame(rows, "id int, body string")
    assert {x["id"]: x["plaintext"] for x in layers.cycled_texts(df, "id", "body").collect()} == want


def test_steps_are_replayed_once(spark):
    files = spark.createDataFrame([(1, "x")], "id long, source string")
    assert layers.replay(files, "id", "source")._jdf.queryExecution().optimizedPlan().toString().count("aggregate(_steps#") == 1

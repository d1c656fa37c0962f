from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.functions import csv_codec, jwt, oauth2, toml_codec, xml_codec, yaml_codec
from millrace.functions.errors import NotSupported


def test_csv_decode():
    d = csv_codec.decode
    assert d("name,age\n\"a \"\"q\"\"\",42\n,,\n"[:-3] + "\n") == [{"name": 'a "q"', "age": "42"}]
    assert d("a,b,c,d\n42,3.14,true,hello\n", {"inferTypes": True}) == [{"a": 42, "b": 3.14, "c": True, "d": "hello"}]
    assert d("a\n 42\n", {"inferTypes": True}) == [{"a": " 42"}] and math.isnan(d("a\nNaN\n", {"inferTypes": True})[0]["a"]) and d("a\n0x1p-2\n", {"inferTypes": True}) == [{"a": 0.25}]
    assert list(d("a,a,a_2,\n1,2\n", {"strict": False})[0]) == ["a", "a_2", "a_2_2", "col4"]
    with pytest.raises(csv_codec.CsvError, match="record 2"):
        d("a,b\n1\n")
    assert d("a,b\n1\n2,3,4\n", {"strict": False}) == [{"a": "1", "b": None}, {"a": "2", "b": "3"}]
    assert csv_codec.decode_rows("1,2,3\n4\n", {"strict": False}) == [["1", "2", "3"], ["4"]]
    assert [n for n, _ in csv_codec.iter_objects("a,b\n1,2\n\n,\n# x\n3,4\n", {"comment": "#"})] == [2, 4]
    assert d("a,b\n , \n", {"trim": False}) == [{"a": " ", "b": " "}] and d("a,b\n , \n", {"trim": True}) == []
    assert d("a\nNULL\n", {"nullValues": ["NULL"]}) == [{"a": None}] and d("1,2\n", {"header": False, "columns": ["x", "y"]}) == [{"x": "1", "y": "2"}]
    for bad in ({"delimiter": "ab"}, {"comment": ","}, {"nosuch": 1}, {"columns": ["a"], "header": True}):
        with pytest.raises(ValueError):
            d("a\n1\n", bad)


def test_csv_encode():
    assert csv_codec.encode([{"a": 1, "b": None}, {"a": "x,\"y\"", "c": 2}]) == 'a,b\n1,\n"x,""y""",\n'
    assert csv_codec.encode([[1, True], ["a b", 1.5]]) == "1,true\na b,1.5\n" and csv_codec.encode([]) == ""
    with pytest.raises(csv_codec.CsvError):
        csv_codec.encode([{"a": 1}, [1]])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="ab,\"\n x", max_size=5), min_size=2, max_size=2), min_size=1, max_size=5))
def test_csv_round_trip(rows):
    assert csv_codec.decode_rows(csv_codec.encode(rows), {"skipEmpty": False}) == rows


def test_xml():
    d = xml_codec.decode('<?xml version="1.0"?><b:book id="1" a="&lt;"><t>x<!-- c -->y</t> <![CDATA[<z>]]></b:book>')
    root = xml_codec.root(d)
    assert root["name"] == "b:book" and xml_codec.attr(d, "a") == "<" and xml_codec.attr(d, "no") is None
    assert [c.get("value", c.get("name")) for c in xml_codec.children(root)] == ["t", " ", "<z>"] and len(xml_codec.children(xml_codec.children(root)[0])) == 2
    assert xml_codec.text(d) == "xy <z>" and xml_codec.encode(d) == '<b:book a="&lt;" id="1"><t>xy</t> &lt;z&gt;</b:book>'
    assert [e["type"] for e in xml_codec.iter_events("<a>x<b/></a>")] == ["startElement", "text", "startElement", "endElement", "endElement"]
    for bad in ("<a><b></a>", "<a/><b/>", "", '<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>'):
        with pytest.raises(xml_codec.XmlError):
            xml_codec.decode(bad)
    with pytest.raises(xml_codec.XmlError):
        xml_codec.encode({"type": "element", "name": "a b"})


def test_yaml():
    y = yaml_codec.decode("a: &x {p: 1, q: yes}\nb:\n  <<: *x\n  p: 2\n1: 2024-01-01\nn: ~\nf: 1e3\no: 0o17\n")
    assert y == {"a": {"p": 1, "q": "yes"}, "b": {"p": 2, "q": "yes"}, "1": "2024-01-01", "n": None, "f": 1000.0, "o": 15}
    assert yaml_codec.decode_all("a: 1\n---\nb: 2\n") == [{"a": 1}, {"b": 2}]
    for bad in ("", "a: 1\n---\nb: 2\n", "a: 18446744073709551615", "a: 1\na: 2", "a: [", "? [1]\n: 2"):
        with pytest.raises(yaml_codec.YamlError):
            yaml_codec.decode(bad)


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**63 - 1) | st.floats(allow_nan=False, allow_infinity=False) | st.text(alphabet=st.characters(blacklist_categories=("Cs", "Cc"), blacklist_characters="\x85  ﻿￾￿"), max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("abc1", min_size=1, max_size=3), x, max_size=3), max_leaves=6)


@settings(max_examples=100, deadline=None)
@given(VALUES)
def test_yaml_round_trip(value):
    assert yaml_codec.decode(yaml_codec.encode(value)) == value


def test_toml():
    assert toml_codec.decode("d=1979-05-27T07:32:00Z\nl=07:32:00.5", {"datetime": "native"}) == {"d": {"flavor": "offset-datetime", "value": "1979-05-27T07:32:00Z"}, "l": {"flavor": "local-time", "value": "07:32:00.5"}}
    v = {"a": 1, "t": {"b": [1, 2], "c d": "x\ny"}, "p": [{"q": 1.5}, {"q": True}]}
    assert toml_codec.decode(toml_codec.encode(v)) == v
    for bad in ({"a": None}, {"a": [{"b": 1}, 2]}, {"a": [[{"b": 1}]]}, []):
        with pytest.raises(toml_codec.TomlError):
            toml_codec.encode(bad)
    for opts in ({"strict": False}, {"datetime": "x"}):
        with pytest.raises(ValueError):
            toml_codec.decode("a=1", opts)


def test_jwt():
    k = jwt.hmac_key("s")
    t = jwt.sign({"sub": "x"}, k, {"expires_in": 60, "issuer": "me", "audience": "you"})
    assert jwt.verify(t, k, {"algorithms": ["HS256"], "issuer": "me", "audience": ["you"], "required": ["sub"]})["verified"] is True
    assert jwt.inspect(t)["claims"]["sub"] == "x" and repr(k) == "<jwt key>"
    for opts in ({}, {"algorithms": ["HS512"]}, {"algorithms": ["none"]}, {"algorithms": ["HS256"], "issuer": "other"}, {"algorithms": ["HS256"], "required": ["jti"]}, {"algorithms": ["HS256"], "now": 9e12}, {"algorithms": ["HS256"], "max_age": 1}):
        with pytest.raises(jwt.JwtError):
            jwt.verify(t, k, opts)
    with pytest.raises(jwt.JwtError):
        jwt.verify(t[:-2] + "AA", k, {"algorithms": ["HS256"]})
    with pytest.raises(jwt.JwtError):
        jwt.sign({"exp": 1}, k, {"expires_in": 60})
    with pytest.raises(jwt.JwtError):
        jwt.sign({}, k, {"header": {"alg": "x"}})
    with pytest.raises(NotSupported):
        jwt.public_key("x")
    jwt.check_times({"exp": 100}, 105, leeway=5)
    with pytest.raises(jwt.JwtError):
        jwt.check_times({"nbf": 100}, 90, leeway=5)


def test_oauth():
    import json

    sent = []

    def transport(method, url, headers, body):
        sent.append((method, url, headers, body))
        return (200, json.dumps({"issuer": "https://i", "token_endpoint": "https://i/t"}).encode()) if method == "GET" else (200, json.dumps({"access_token": "abc", "token_type": "Bearer", "expires_in": 10, "scope": "a b", "refresh_token": "r"}).encode())

    p = oauth2.discover("https://i", transport)
    c = oauth2.client(p, {"clientID": "me", "clientSecret": "hush"}, transport)
    t = c.client_credentials({"scopes": ["a"]})
    assert t.scopes == ("a", "b") and not t.expired() and t.expired(skew_ms=60_000) and t.auth_header() == {"Authorization": "Bearer abc"} and 0 < t.valid_for() <= 10_000
    assert c.refresh(t).access_token() == "abc" and "hush" not in repr(c) and "abc" not in repr(t)
    for bad in ({"tokenEndpoint": "http://x/t"}, {"tokenEndpoint": "https://x/t", "nosuch": 1}):
        with pytest.raises(ValueError):
            oauth2.provider(bad)
    assert oauth2.Token("a").valid_for() is None and oauth2.Token("a", expiresAt=1.0004).valid_for(now=1.0) == 1

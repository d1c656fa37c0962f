from __future__ import annotations

from millrace.functions import sql_functions


def test_sql_functions(spark):
    names = sql_functions.register(spark, "mr_")
    assert len(names) == len(set(names)) == 24
    one = lambda q: spark.sql(f"SELECT {q} AS x").first().x
    assert one("mr_css_query('<p>a</p><p>b</p>', 'p >> :text()', '')") == ["a", "b"] and one("mr_css_count('<p><p>', 'p')") == 2 and one("mr_css_count(CAST(NULL AS STRING), 'p')") is None
    assert one("mr_xpath_query('<p>a</p>', '//p/text()')") == ["a"] and one("mr_csv_decode('a\\n1\\n', '{\"inferTypes\": true}')") == '[{"a": 1}]'
    assert one("mr_yaml_decode('a: [1, x]')") == '{"a": [1, "x"]}' and one("mr_toml_encode('{\"a\": 1}')") == "a = 1\n" and one("mr_xml_encode(mr_xml_decode('<a b=\"1\">x</a>'))") == '<a b="1">x</a>'
    assert one("mr_robots_allows('User-agent: *\\nDisallow: /a', '/ab', 'x')") is False and one("mr_robots_match('User-agent: *\\nDisallow: /a', '/ab', 'x')").pattern == "/a"
    assert one("mr_article_extract('<title>T | Some Site</title>', 'http://h/')").title == "Some Site" and one("mr_resolve_url('http://h/a', 'b')") == "http://h/b" and one("mr_to_number('1,5')") == 1.5
    rows = spark.sql("SELECT v.* FROM (SELECT '<ul><li>1<li>2</ul>' AS h) t, LATERAL mr_dom_nodes(t.h) v WHERE v.name = 'li'").collect()
    assert [r.text for r in rows] == ["1", "2"]
    assert spark.sql("SELECT record FROM mr_csv_records('a,b\\n1,2\\n', '{}')").first().record == {"a": "1", "b": "2"}
    assert [r.type for r in spark.sql("SELECT * FROM mr_xml_events('<a>x</a>') ORDER BY event_no").collect()] == ["startElement", "text", "endElement"]
    assert spark.sql("SELECT * FROM mr_yaml_documents('a: 1\\n---\\nb: 2')").count() == 2 and spark.sql("SELECT loc FROM mr_sitemap_entries('<urlset><url><loc>u</loc></url></urlset>', '')").first().loc == "u"

"""XML documents as trees, against a plain tree walk."""

import random
import xml.etree.ElementTree as ET

from cloakframe import FieldRule, Policy, mask_with_stats
from cloakframe.sources.formats import mask_xml_text

POLICY = Policy.only("s", "email", "ip_address").with_field_rules(
    password=FieldRule(action="remove"), token=FieldRule(action="replace", replacement="<t>")
)
NAMES = ["a", "b", "password", "token", "Note"]
TEXTS = [None, "", " ", "\n  ", "u@mail.ru", "x & <y> u@mail.ru", "10.0.0.1 'q' \"r\"", "é😀 v@mail.ru", "plain", "a=b"]


def grown(rnd, depth):
    element = ET.Element(rnd.choice(NAMES), {rnd.choice([*NAMES, "id"]): rnd.choice(TEXTS) or "" for _ in range(rnd.randrange(3))})
    element.text, element.tail = rnd.choice(TEXTS), rnd.choice(TEXTS)
    for _ in range(rnd.randrange(4) if depth else 0):
        element.append(grown(rnd, depth - 1))
    return element


def plain(element, masks, parent=""):
    """The rules of the operator, by a walk over the tree."""

    def new(name, text):
        rule = {"password": "remove", "token": "replace"}.get(name.lower())
        return None if rule == "remove" else "<t>" if rule == "replace" else masks[text]

    if element.tail and element.tail.strip():
        element.tail = new(parent, element.tail) if new(parent, element.tail) is not None else element.tail
    if element.text:
        element.text = new(element.tag, element.text) or ""
    for name, value in list(element.attrib.items()):
        if new(name, value) is None:
            del element.attrib[name]
        else:
            element.attrib[name] = new(name, value)
    for child in element:
        plain(child, masks, element.tag)


def test_trees_by_plain_walk(spark):
    rnd = random.Random(8)
    masked = mask_with_stats(spark.createDataFrame([(t,) for t in TEXTS if t is not None], "text string").selectExpr("text AS old", "text"), POLICY)
    masks = {r.old: r.text for r in masked.collect()}
    trees = [grown(rnd, 4) for _ in range(60)]
    for tree in trees:
        tree.tail = None
    rows = [(i, ET.tostring(t, encoding="unicode")) for i, t in enumerate(trees)]
    got = {r.id: r.text for r in mask_xml_text(spark.createDataFrame(rows, "id int, text string"), POLICY).collect()}
    for i, tree in enumerate(trees):
        plain(tree, masks)
        assert ET.canonicalize(got[i]) == ET.canonicalize(ET.tostring(tree, encoding="unicode"))


def test_what_is_not_text_stays(spark):
    rows = [
        (1, "<?xml version='1.0'?><!DOCTYPE a [<!ENTITY e 'u@mail.ru'>]><a xmlns:m='http://10.0.0.1'>&e; u@mail.ru</a>"),
        (2, None), (3, ""), (4, "u@mail.ru"), (5, "<a><!-- <b> --><?p 10.0.0.1?></a>"), (6, "<a>" * 3000 + "u@mail.ru" + "</a>" * 3000),
        (7, "<a t='" + "x " * 200_000 + "u@mail.ru'>" + "y " * 200_000 + "</a>"),
    ]
    got = {r.id: r for r in mask_xml_text(spark.createDataFrame(rows, "id int, text string"), POLICY).collect()}
    assert got[1].text.startswith(rows[0][1][:86]) and got[1].text.endswith("</a>") and "&e; EMAIL_" in got[1].text
    assert (got[2].text, got[2].matches_found, got[3].text) == (None, 0, "")
    assert got[4].text.startswith("EMAIL_") and got[5].text.startswith("<a><!-- <b> --><?p IP_")
    assert got[6].text.count("<a>") == 3000 and got[6].matches_applied == 1
    assert got[7].matches_applied == 1 and "u@mail.ru" not in got[7].text

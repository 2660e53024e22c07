"""Plain-Python counterparts shared by the tests."""

import re

SF = "/root/testdata/sf0.001"
WS = re.compile("[\x20\x09-\x0D]+")


def plain_words(text):
    return [w for w in WS.split(text or "") if w]

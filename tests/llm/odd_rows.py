"""Texts that are easy to get wrong, and the order of collected rows."""

TEXTS = {
    0: None, 1: "", 2: "   \n\t ", 3: "one", 4: "The of and to in a is that it for on was with as be by the end.",
    5: "Grüße aus dem Süden\nund ein zweiter Satz, 12 mal 'so' wie's geht!  Doppelt.", 6: "日本語のテキスト と 😀 emoji \x1c\x85\xa0 end",
    7: "word " * 4000, 8: "x" * 20000, 9: "one", 10: "123 456 !!! ???",
}


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)

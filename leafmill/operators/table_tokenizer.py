"""Tables of a text by the standard HTML tokenizer, for texts that need more than patterns."""

from __future__ import annotations

from html.parser import HTMLParser


class Tables(HTMLParser):
    def __init__(self, source: str):
        super().__init__(convert_charrefs=False)
        self.source, self.open, self.found, self.lines = source, [], [], [0]
        for line in source.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.feed(source)
        self.close()
        for table in self.open:
            self.finish(table, len(source))

    def here(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def put(self, piece: str, outer_only: bool = False) -> None:
        for table in self.open[:-1] if outer_only else self.open:
            if table["cell"]:
                table["own"].append(piece)

    def end_cell(self, table: dict) -> None:
        if table["cell"]:
            table["own"].append(f"</{table['cell']}>")
            table["cell"] = None

    def end_row(self, table: dict) -> None:
        self.end_cell(table)
        if table["row"]:
            table["own"].append("</tr>")
            table["row"] = False

    def finish(self, table: dict, end: int) -> None:
        self.end_row(table)
        table["own"].append("</table>")
        table["end"] = end

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.put("<x>")
            table = {"start": self.here(), "own": ["<table>"], "cell": None, "row": False}
            self.open.append(table)
            self.found.append(table)
        elif self.open and tag in ("tr", "td", "th"):
            self.put("<x>", outer_only=True)
            table = self.open[-1]
            (self.end_row if tag == "tr" else self.end_cell)(table)
            if not table["row"]:
                table["own"].append("<tr>")
                table["row"] = True
            if tag != "tr":
                spans = "".join(f' {k}="{v}"' for k, v in attrs if k in ("rowspan", "colspan") and (v or "").strip().isdigit())
                table["own"].append(f"<{tag}{spans}>")
                table["cell"] = tag
        else:
            self.put("<x>")

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            end = self.source.find(">", self.here())
            self.finish(self.open.pop(), len(self.source) if end < 0 else end + 1)
            self.put("<x>")
        elif self.open and tag in ("tr", "td", "th"):
            (self.end_row if tag == "tr" else self.end_cell)(self.open[-1])
            self.put("<x>", outer_only=True)
        else:
            self.put("<x>")

    def handle_data(self, data):
        if self.cdata_elem is None:
            self.put(data)

    def handle_entityref(self, name):
        self.put(self.source[self.here():self.here() + len(name) + 2] if self.source[
            self.here() + len(name) + 1:][:1] == ";" else f"&{name}")

    def handle_charref(self, name):
        self.put(f"&#{name};")


def tables_in(text: str) -> list[dict[str, str]]:
    """Every table of a text, outer and inner ones both, in order of the opening tags.

    ``html`` is the source from the opening tag to its end.  ``own`` repeats the rows and cells of the
    table's own level, each closed, cells with their spans, with the text of everything inside; tags of inner levels
    become ``<x>``.
    """
    return [{"html": text[t["start"]:t["end"]], "own": "".join(t["own"])} for t in Tables(text).found]

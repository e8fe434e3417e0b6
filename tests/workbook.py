"""A minimal workbook writer for tests."""

import zipfile
from xml.sax.saxutils import escape


def letters(n):
    out = ""
    n += 1
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def write(path, sheets, merges=None, shared=False, styles=(0, 14, 165)):
    """``sheets`` is {name: {(row, col): value}}; a value may be (number, style index)."""
    strings, parts = [], {}
    for n, (name, cells) in enumerate(sheets.items(), 1):
        rows = {}
        for (r, c), v in sorted(cells.items()):
            ref = f"{letters(c)}{r + 1}"
            if isinstance(v, bool):
                x = f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
            elif isinstance(v, tuple):
                x = f'<c r="{ref}" s="{v[1]}"><v>{v[0]}</v></c>'
            elif isinstance(v, (int, float)):
                x = f'<c r="{ref}"><v>{v!r}</v></c>'
            elif shared:
                strings.append(v)
                x = f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>'
            else:
                x = f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
            rows.setdefault(r, []).append(x)
        body = "".join(f'<row r="{r + 1}">{"".join(xs)}</row>' for r, xs in rows.items())
        marked = "".join(f'<mergeCell ref="{m}"/>' for m in (merges or {}).get(name, []))
        parts[f"xl/worksheets/sheet{n}.xml"] = (
            f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData>'
            + (f"<mergeCells>{marked}</mergeCells>" if marked else "")
            + "</worksheet>"
        )
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    listed = "".join(f'<sheet name="{escape(name)}" sheetId="{n}" r:id="rId{n}"/>' for n, name in enumerate(sheets, 1))
    parts["xl/workbook.xml"] = (
        f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>'
    )
    linked = "".join(
        f'<Relationship Id="rId{n}" Type="{rel}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(sheets) + 1)
    )
    parts["xl/_rels/workbook.xml.rels"] = (
        f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{linked}</Relationships>'
    )
    formats = "".join(f'<xf numFmtId="{s}"/>' for s in styles)
    parts["xl/styles.xml"] = (
        '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
        f'<numFmts><numFmt numFmtId="165" formatCode="yyyy\\-mm\\-dd"/></numFmts><cellXfs>{formats}</cellXfs></styleSheet>'
    )
    if shared:
        items = "".join(f"<si><t>{escape(s)}</t></si>" for s in strings)
        parts["xl/sharedStrings.xml"] = (
            f'<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{items}</sst>'
        )
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


def grid(lines, at=(0, 0)):
    return {(at[0] + r, at[1] + c): v for r, line in enumerate(lines) for c, v in enumerate(line) if v is not None}

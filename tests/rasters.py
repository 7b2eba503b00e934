"""Rasters drawn as text: one character a pixel, '.' for none."""


def drawn(spark, text, column="label"):
    rows = [r for r in text.split()]
    h, w = len(rows), len(rows[0])
    out = []
    for y, line in enumerate(rows):
        for x, c in enumerate(line):
            value = (None if c == "." else int(c)) if column == "label" else c == "#"
            out.append((1, w, h, x, y, value))
    return spark.createDataFrame(out, f"image_id long, w int, h int, x int, y int, {column} {'int' if column == 'label' else 'boolean'}")


def shown(df, column="label"):
    rows = sorted(df.select("y", "x", column).collect())
    w = max(r.x for r in rows) + 1
    said = [("." if r[2] is None else str(r[2])) if column == "label" else "#" if r[2] else "." for r in rows]
    return [" ".join("".join(said[k : k + w]) for k in range(0, len(said), w))][0].split()

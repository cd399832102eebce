"""T1 evaluated in the row against the job-level compiler, and its errors against the parser's."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from quire.operators.rowtemplate import render_row
from quire.operators.templates import TemplateError, compile_template, parse_template
from quire.plans.queries_results import TEMPLATE

VARS = {"title": ["T"], "author": ["Ann", "", "Bob"], "none": [], "x": ["1", "2"], "y": ["a"], "": ["?"], "el": [None, "z"]}
FIXED = [
    "", "plain", "$$", "$$$title$$$", "a $title$ b", "$missing$", "$body$ and $body$", TEMPLATE, "$for(x)$$for(x)$[$x$]$sep$,$endfor$$sep$;$endfor$",
    "$for(x)$$x$:$for(author)$$if(author)$$author$$else$-$endif$$x$$sep$|$endfor$$sep$ / $endfor$", "$for(none)$never$sep$,$endfor$!",
    "$if(x)$$if(none)$A$else$B$for(y)$$y$$x$$endfor$$endif$$else$C$endif$", "$if(none)$$for(x)$$x$$endfor$off$endif$on",
    "$for(x)$$if(y)$$y$$else$no$endif$$sep$$x$$y$$endfor$", "$for(body)$<$body$>$endfor$", "$for(el)$($el$)$endfor$ $el$", "$not a var$ $ $5 $a.b-c_d$",
    "$for(author)$$sep$x$endfor$", "$for(x)$$sep$$endfor$", "$if(body)$$endif$", "$for(x)$$if(none)$$else$$for(y)$$x$$y$$endfor$$endif$$endfor$",
]
WRONG = ["$else$", "$endif$", "ab$endfor$", "$if(x)$", "a$for(x)$b$if(y)$", "$if(x)$$sep$$endif$", "$for(x)$$else$$endfor$", "$if(x)$$else$$else$$endif$",
         "$if(x)$$endfor$", "$for(x)$$endif$", "$for(x)$$sep$$sep$$endfor$", "$sep$", "$if(x)$a$endif$$endif$ $else$"]


def made(seed):
    """A template with balanced blocks."""
    rng = random.Random(seed)
    names = [*VARS, "body", "missing"]
    names.remove("")

    def part(depth):
        out = []
        for _ in range(rng.randrange(1, 5)):
            name, kind = rng.choice(names), rng.random()
            if kind < 0.35 or depth > 2:
                out.append(rng.choice([f"${name}$", "text ", "\n", "$$", f"<${name}$>"]))
            elif kind < 0.65:
                out.append(f"$if({name})$" + part(depth + 1) + (f"$else${part(depth + 1)}" if rng.random() < 0.5 else "") + "$endif$")
            else:
                out.append(f"$for({name})$" + part(depth + 1) + (f"$sep${part(depth + 1)}" if rng.random() < 0.5 else "") + "$endfor$")
        return "".join(out)

    return part(0)


def base(spark, templates):
    rows = [(k, t, VARS, f"Body of $title$ {k}") for k, t in enumerate(templates)]
    return spark.createDataFrame(rows, "k int, t string, v map<string,array<string>>, b string")


def test_same_as_the_compiled_template(spark):
    templates = FIXED + [made(s) for s in range(16)]
    df = base(spark, templates)
    got = {r.k: r.x for r in df.select("k", render_row(F.col("t"), F.col("v"), F.col("b")).alias("x")).collect()}
    some = list(range(len(FIXED))) + list(range(len(FIXED), len(templates)))
    for at in range(0, len(some), 6):
        part = some[at : at + 6]
        want = df.where(F.col("k").isin(part)).select("k", *[F.when(F.col("k") == k, compile_template(
            templates[k], F.col("v"), F.col("b"))).alias(f"c{k}") for k in part]).collect()
        for r in want:
            assert (got[r.k].text, got[r.k].error) == (r[f"c{r.k}"], None), templates[r.k]


def test_errors_are_the_parsers(spark):
    got = {r.t: r.x for r in base(spark, WRONG).select("t", render_row(F.col("t"), F.col("v"), F.col("b")).alias("x")).collect()}
    for t in WRONG:
        with pytest.raises(TemplateError) as e:
            parse_template(t)
        assert (got[t].text, got[t].error) == (None, str(e.value))
    assert base(spark, [None]).select(render_row(F.col("t"), F.col("v"), F.col("b"))).first()[0] is None


def test_large_template(spark):
    """2,000 and 4,000 tokens, and a loop over 2,000 and 4,000 values: about linear."""
    for make in (lambda n: ("$if(title)$a$title$$else$b$endif$ " * (n // 4), VARS), lambda n: ("$for(x)$<$x$>$sep$, $endfor$", VARS | {"x": [str(k) for k in range(n)]})):
        took = []
        for n in (50, 2000, 4000, 8000):
            t, v = make(n)
            df = spark.createDataFrame([(t, v, "body")], "t string, v map<string,array<string>>, b string").select(
                render_row(F.col("t"), F.col("v"), F.col("b")).alias("x"))
            df.collect()
            began = time.perf_counter()
            assert df.first().x.error is None
            took.append(time.perf_counter() - began)
        assert took[1] < 5 and took[2] < 3 * took[1] + 0.5 and took[3] < 3 * took[2] + 0.5, took

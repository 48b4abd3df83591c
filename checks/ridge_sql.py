"""Nested-CV ridge with one or two predictors as SQL, in closed form.

Mirrors the rule, not the code: folds from MD5 and whole days, 50 penalties
from 1e-2 to 1e4, predictors scaled by their deviation in the outer training
set, inner scores averaged, first best penalty taken.
"""

from __future__ import annotations


def ridge_ctes(rows: str, tag: str = "") -> str:
    """CTEs ending in ``scored{tag}`` (k, alpha, r2); ``rows`` selects id, day, a, b and y.

    With a constant ``b`` the model has one predictor.
    """
    sums = "count(*)::DOUBLE AS n, sum(a) AS a, sum(b) AS b, sum(y) AS y, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_, sum(y * y) AS yy"
    names = ["n", "a", "b", "y", "aa", "ab", "bb", "ay", "by_", "yy"]
    less = ", ".join(f"t.{c} - c.{c} AS {c}" for c in names)
    total = ", ".join(f"sum({c}) AS {c}" for c in names)

    def fit(source: str, deviation: str, keys: str) -> str:
        """Scaled coefficients for every penalty of the training sums in ``source``."""
        return f"""SELECT {keys}, g.alpha, p.a / p.n AS ma, p.b / p.n AS mb, p.y / p.n AS my, d.sa, d.sb,
               (p.aa - p.a * p.a / p.n) / (d.sa * d.sa) + g.alpha AS caa, (p.ab - p.a * p.b / p.n) / (d.sa * d.sb) AS cab,
               (p.bb - p.b * p.b / p.n) / (d.sb * d.sb) + g.alpha AS cbb,
               (p.ay - p.a * p.y / p.n) / d.sa AS cay, (p.by_ - p.b * p.y / p.n) / d.sb AS cby
               FROM {source} p JOIN {deviation} d USING (k) CROSS JOIN grid{tag} g"""

    def solved(source: str) -> str:
        return f"""SELECT *, (cbb * cay - cab * cby) / (caa * cbb - cab * cab) / sa AS ba,
                   (caa * cby - cab * cay) / (caa * cbb - cab * cab) / sb AS bb_ FROM {source}"""

    def r2(f: str, h: str) -> str:
        """1 - SSE / SST of the held-out sums ``h`` under the fit ``f``."""
        about = {
            "aa": f"({h}.aa - 2 * {f}.ma * {h}.a + {h}.n * {f}.ma * {f}.ma)", "bb": f"({h}.bb - 2 * {f}.mb * {h}.b + {h}.n * {f}.mb * {f}.mb)",
            "ab": f"({h}.ab - {f}.ma * {h}.b - {f}.mb * {h}.a + {h}.n * {f}.ma * {f}.mb)", "yy": f"({h}.yy - 2 * {f}.my * {h}.y + {h}.n * {f}.my * {f}.my)",
            "ay": f"({h}.ay - {f}.ma * {h}.y - {f}.my * {h}.a + {h}.n * {f}.ma * {f}.my)", "by": f"({h}.by_ - {f}.mb * {h}.y - {f}.my * {h}.b + {h}.n * {f}.mb * {f}.my)",
        }
        sse = f"""({about['yy']} - 2 * ({f}.ba * {about['ay']} + {f}.bb_ * {about['by']})
               + {f}.ba * {f}.ba * {about['aa']} + 2 * {f}.ba * {f}.bb_ * {about['ab']} + {f}.bb_ * {f}.bb_ * {about['bb']})"""
        return f"1 - {sse} / ({h}.yy - {h}.y * {h}.y / {h}.n)"

    return f"""given{tag} AS ({rows}),
    centre{tag} AS (SELECT avg(a) AS ca, avg(b) AS cb, avg(y) AS cy FROM given{tag}),
    folded{tag} AS (SELECT day, a - ca AS a, b - cb AS b, y - cy AS y, ('0x' || substr(md5('42:' || id), 1, 8))::BIGINT % 5 AS fold FROM given{tag}, centre{tag}),
    outers{tag} AS (SELECT unnest(range(6)) AS k),
    grid{tag} AS (SELECT i, power(10, -2 + 6 * i / 49.0) AS alpha FROM (SELECT unnest(range(50)) AS i)),
    days{tag} AS (SELECT k, day, count(*) AS n FROM folded{tag}, outers{tag} WHERE fold <> k GROUP BY k, day),
    parts{tag} AS (SELECT k, day, least((sum(n) OVER (PARTITION BY k ORDER BY day) - n) * 5 // sum(n) OVER (PARTITION BY k), 4) AS j FROM days{tag}),
    cells{tag} AS (SELECT k, j, {sums} FROM folded{tag} JOIN parts{tag} USING (day) WHERE fold <> k GROUP BY k, j),
    train{tag} AS (SELECT k, {total} FROM cells{tag} GROUP BY k),
    held{tag} AS (SELECT fold AS k, {sums} FROM folded{tag} GROUP BY fold),
    deviation{tag} AS (SELECT k, CASE WHEN aa - a * a / n > 1e-9 THEN sqrt((aa - a * a / n) / n) ELSE 1 END AS sa,
        CASE WHEN bb - b * b / n > 1e-9 THEN sqrt((bb - b * b / n) / n) ELSE 1 END AS sb FROM train{tag}),
    inside{tag} AS (SELECT c.k, c.j, {less} FROM train{tag} t JOIN cells{tag} c USING (k)),
    inner_fit{tag} AS ({solved('(' + fit(f'inside{tag}', f'deviation{tag}', 'p.k, p.j') + ')')}),
    inner_score{tag} AS (SELECT f.k, f.alpha, sum({r2('f', 'h')}) AS s FROM inner_fit{tag} f JOIN cells{tag} h ON f.k = h.k AND f.j = h.j GROUP BY f.k, f.alpha),
    best{tag} AS (SELECT k, alpha FROM inner_score{tag} QUALIFY row_number() OVER (PARTITION BY k ORDER BY s DESC, alpha) = 1),
    outer_fit{tag} AS ({solved('(' + fit(f'train{tag}', f'deviation{tag}', 'p.k') + ')')}),
    scored{tag} AS (SELECT f.k, f.alpha, CASE WHEN f.k < 5 THEN {r2('f', 'h')} END AS r2
        FROM outer_fit{tag} f JOIN best{tag} USING (k, alpha) LEFT JOIN held{tag} h ON h.k = f.k)"""

"""Column functions that render a card. Values are data: markup in them is kept, no script is emitted."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_FRONT = ('<div class="sentence" style="text-align: center;">', "</div>")
_BACK = ('<div style="text-align: center;">\n', "\n</div>")


def front_html(chosen: Column) -> Column:
    return F.concat(F.lit(_FRONT[0]), F.coalesce(chosen, F.lit("")), F.lit(_FRONT[1]))


def back_html(front: Column, pronunciation: Column, meaning: Column) -> Column:
    """The front again, a rule, the pronunciation unless it is empty, and the meaning."""
    spoken = F.when(F.coalesce(pronunciation, F.lit("")) != "", F.concat(F.lit('<div class="notes"><i>'), pronunciation, F.lit("</i></div>\n"))).otherwise("")
    return F.concat(F.lit(_BACK[0]), front, F.lit("\n<hr>\n"), spoken, F.lit('<div class="meaning">'), F.coalesce(meaning, F.lit("")), F.lit("</div>"), F.lit(_BACK[1]))

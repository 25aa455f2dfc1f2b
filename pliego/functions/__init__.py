"""Column -> Column scalar expressions. All are built-in Spark expressions
(no Python UDF), so they stay inside whole-stage codegen."""

from pliego.functions.text import *  # noqa: F401,F403
from pliego.functions.money import *  # noqa: F401,F403
from pliego.functions.dates import *  # noqa: F401,F403
from pliego.functions.links import *  # noqa: F401,F403

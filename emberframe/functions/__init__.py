"""Column expressions. All are built-in functions; none is a UDF."""

from emberframe.functions.keys import *  # noqa: F403
from emberframe.functions.spectral import *  # noqa: F403
from emberframe.functions.weather import *  # noqa: F403

"""threadlens: discussion-thread analytics as Spark DataFrame operations.

Tables of posts and comments in, one report row per post out. Every
operator is a ``DataFrame -> DataFrame`` or ``Column -> Column`` function
built from Spark SQL expressions; grouped operators take ``by=`` so they
work on any thread-like table.
"""

from threadlens.params import Params

__all__ = ["Params"]

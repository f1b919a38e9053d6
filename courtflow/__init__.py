"""Match analytics for recorded doubles court sport, as PySpark DataFrame operators.

Every operator is a plain ``DataFrame -> DataFrame`` function keyed by ``match_id``
and works on all matches at once.
"""

"""DataFrame-to-DataFrame operators, keyed by ``(symbol, session)`` unless stated otherwise."""

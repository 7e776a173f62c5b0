"""DataFrame → DataFrame operators. None of them writes or changes the session."""

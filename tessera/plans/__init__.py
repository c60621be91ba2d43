"""Named queries: each a function of (spark, folder), with equivalent SQL where there is one."""

"""Every operator and job run on the driver's tables, each with equivalent SQL."""

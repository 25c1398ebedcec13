"""Training-data operators. Nothing outside this folder (but for the guarded entry module) imports it."""

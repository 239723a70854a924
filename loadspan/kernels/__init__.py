"""Sequential numpy kernels that run inside grouped functions and streaming state."""

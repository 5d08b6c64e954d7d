"""DataFrame operators that the pipe language lowers to; usable on their own."""

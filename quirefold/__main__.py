import sys

from quirefold.cli import main

sys.exit(main())

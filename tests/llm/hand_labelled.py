"""Pages labelled by hand, block by block (1: main text). Their containers carry names that the training labels do not know, or none."""

S = "The river rose again last night, and the lower meadows stood under water until the morning. "
T = "Farmers moved their cattle to the hills in time; nobody was hurt, though two bridges were closed. "
U = "Engineers expect the level to fall within three days if the weather stays dry. "

PAGES = [
    # a newspaper: everything in plain divs
    [("<body><div class='hd-zone'><div>", None), ("<span>The Valley Gazette</span></div>", 0), ("<div><a href='/'>Front page</a></div>", 0), ("<div><a href='/w'>Weather</a></div>", 0), ("<div><a href='/s'>Sport</a></div></div>", 0),
     ("<div class='zq-wrap'><h1>Floods in the lower valley</h1>", 1), (f"<p>{S}{T}</p>", 1), (f"<p>{T}{U}{S}</p>", 1), ("<h2>What comes next</h2>", 1), (f"<p>{U}{S}{U}</p></div>", 1),
     ("<div class='rail-box'><div><a href='/1'>Five walks for the weekend</a></div>", 0), ("<div><a href='/2'>Market opens</a></div></div>", 0), ("<div class='ft-zone'><p>&copy; Valley Gazette</p></div></body>", 0)],
    # a blog with a notice on top
    [("<body><div id='xk'><p>We use cookies. <a href='/c'>Accept</a></p></div>", 0), ("<div id='mm'><ul><li><a href='/a'>About</a>", 0), ("<li><a href='/r'>Archive</a></ul></div>", 0),
     (f"<section><h1>Notes from the hills</h1>", 1), (f"<p>{T}{T}</p>", 1), (f"<blockquote>{S}</blockquote>", 1), (f"<p>{U}{T}</p>", 1), ("<ul><li>" + U, 1), ("<li>" + S + "</ul></section>", 1),
     ("<div id='yy'><p><a href='/p'>Previous</a></p>", 0), ("<p><a href='/n'>Next</a></p></div>", 0), ("<div id='zz'><p>Written with love. <a href='/f'>Feed</a></p></div></body>", 0)],
    # an old page: a table for layout
    [("<body><table><tr><td><a href='/1'>Index</a><br><a href='/2'>Links</a><br><a href='/3'>Mail</a>", 0), (f"<td><h1>Bridge report</h1>", 1), (f"<p>{S}{U}{T}", 1), (f"<p>{T}{S}", 1), (f"<p>{U}{U}{S}</table>", 1),
     ("<p><a href='/top'>Top</a></p></body>", 0)],
    # an article element, with other matter inside in containers of unknown names
    [("<body><nav><a href='/'>Home</a></nav>", 0), ("<article><h1>Cattle on the hills</h1>", 1), (f"<p>{T}{S}</p>", 1), (f"<p>{S}{U}</p>", 1), ("<footer><p>Page 3</p></footer>", 0), (f"<p>{U}{T}{S}</p></article>", 1),
     ("<footer><p>&copy; 2024 the authors</p></footer></body>", 0)],
    # a wiki
    [("<body><div class='p-b'><ul><li><a href='/m'>Main page</a></li>", 0), ("<li><a href='/x'>Random</a></li>", 0), ("<li><a href='/h'>Help</a></li></ul></div>", 0), ("<div class='mw'><h1>Lower valley</h1>", 1), (f"<p>{S}{T}{U}</p>", 1),
     (f"<h2>Floods</h2>", 1), (f"<p>{T}{U}</p>", 1), (f"<p>{S}</p>", 1), (f"<h2>Bridges</h2>", 1), (f"<p>{U}{S}{T}</p></div>", 1), ("<div class='ftx'><ul><li><a href='/pr'>Privacy</a></li>", 0), ("<li><a href='/ds'>Disclaimers</a></li></ul></div></body>", 0)],
    # a shop's magazine
    [("<body><header><p>Free shipping</p></header>", 0), ("<div class='offer9'><p>Boots now half price. <a href='/b'>Buy</a></p></div>", 0), (f"<main><h1>Walking in wet weather</h1>", 1), (f"<p>{S}{S}</p>", 1), (f"<p>{T}{U}</p>", 1),
     ("<p>" + U + T + "</p></main>", 1), ("<aside><p><a href='/k'>Our new coats</a></p></aside>", 0), ("<form><p>Your mail address</p></form>", 0), ("<footer><p><a href='/i'>Imprint</a></p></footer></body>", 0)],
]
